"""All registered relational queries with their oracle SQL."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import vectors
from sparkloom.operators import aggregates, joins
from sparkloom.plans import formats, measures, streams  # noqa: F401  (their queries register themselves)
from sparkloom.plans.registry import ORACLE, QUERIES, Query, query
from sparkloom.plans.shared_sql import TEXTS
from sparkloom.sources.tables import stream, table
from sparkloom.streaming import windows

def _shared(text: str) -> Query:
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return lambda spark, sf_dir: spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


for _name, _text in TEXTS.items():
    QUERIES[_name] = _shared(_text)
    ORACLE[_name] = re.sub(r"\{(\w+)\}", r"\1", _text)


@query("""
SELECT r_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY r_name""")
def revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-table star join; the dimension sides are small enough for Catalyst to broadcast by itself."""
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01'")
    return (
        lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name")
        .agg(
            F.count("*").alias("n_lines"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        )
    )


@query("""
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts AS view_ts, value AS view_value FROM events WHERE event_type = 'view')
SELECT event_id, p.user_id, ts, view_ts, view_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.view_ts""")
def last_view_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    return joins.as_of_join(bought, seen, "user_id", "ts", "view_ts", ["view_ts", "view_value"])


@query("""
WITH bands AS (SELECT p_partkey, p_retailprice AS low, p_retailprice + 5 AS high FROM part WHERE p_size <= 5)
SELECT p_partkey, count(*) AS n FROM customer JOIN bands ON c_acctbal >= low AND c_acctbal < high GROUP BY p_partkey""")
def balances_in_price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = table(spark, sf_dir, "part").where("p_size <= 5").select("p_partkey", F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 5).alias("high"))
    found = joins.range_join(table(spark, sf_dir, "customer").select("c_acctbal"), bands, "c_acctbal", "low", "high", 5.0)
    return found.groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("""
SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def salted_orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    placed = joins.salted_join(orders, table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return (
        placed.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query("""
SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 10""")
def largest_orders_of_each_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return aggregates.top_k(rows, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_returnflag")
def orders_of_each_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.exact_distinct(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_orderkey", "n_orders")


@query("""
WITH marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM numbered GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.window("ts", "1 day")["start"].alias("day")
    return table(spark, sf_dir, "events").groupBy(day, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""
SELECT event_type, count(*) FILTER (WHERE dayofweek(ts) = 0) AS sunday, count(*) FILTER (WHERE dayofweek(ts) = 1) AS monday, count(*) FILTER (WHERE dayofweek(ts) = 6) AS saturday
FROM events GROUP BY event_type""")
def weekday_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("event_type", F.dayofweek("ts").alias("d"))
    counts = days.groupBy("event_type").pivot("d", [1, 2, 7]).count()
    return counts.select("event_type", *[F.coalesce(f"`{k}`", F.lit(0).cast("long")).alias(n) for k, n in ((1, "sunday"), (2, "monday"), (7, "saturday"))])


@query("SELECT s_suppkey, 'balance' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier")
def supplier_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return wide.unpivot("s_suppkey", ["balance", "nation"], "name", "value")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""
SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE word <> '' GROUP BY word""")
def words_of_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def conversations_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), turns.alias("t"))
    return whole.select("conv_id", "n_turns", F.concat_ws(">", "t.role").alias("roles"), F.md5(F.concat_ws("\n", "t.text")).alias("digest"))


@query("""
WITH c AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM c GROUP BY label, i)
SELECT label, round(sqrt(sum(x * x)), 6) AS norm, count(*) AS dims FROM m GROUP BY label""")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"), F.count("*").alias("dims"))


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS square,
  round(sqrt(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) - 1) * (CAST(x AS DOUBLE) - 1)))), 6) AS to_ones FROM embeddings""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ones = F.transform("embedding", lambda x: F.lit(1.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot("embedding", "embedding"), 6).alias("square"), F.round(vectors.l2_distance("embedding", ones), 6).alias("to_ones"))


def _largest_gap(values: pd.Series) -> float:
    return float(np.diff(np.sort(values)).max(initial=0.0))


@query("SELECT o_orderstatus, round(exp(avg(ln(o_totalprice))), 4) AS mean FROM orders GROUP BY o_orderstatus")
def geometric_mean_udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's aggregate as an expression of built-in ones, so that it is combined before the exchange."""
    mean = F.exp(F.avg(F.ln("o_totalprice")))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(mean, 4).alias("mean"))


@query("""
WITH g AS (SELECT o_custkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS gap FROM orders)
SELECT o_custkey, round(coalesce(max(gap), 0), 2) AS gap FROM g GROUP BY o_custkey""")
def largest_gaps_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas aggregate, for groups that are known to be small (the orders of one customer)."""
    gap = F.pandas_udf(_largest_gap, "double")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(gap("o_totalprice"), 2).alias("gap"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def null_aware_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.not_in(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", table(spark, sf_dir, "lineitem").where("l_quantity > 45"), "l_partkey")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def range_frame_last_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.range_counts(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", "ts", 3600).select("event_id", "n")


@query("SELECT event_type, round(median(value), 6) AS mid FROM events GROUP BY event_type")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.exact_median(table(spark, sf_dir, "events"), "event_type", "value", "mid")
    return found.select("event_type", F.round("mid", 6).alias("mid"))


@query("SELECT event_type, true AS near_distinct, true AS near_median FROM events GROUP BY event_type")
def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether HyperLogLog and quantile sketches, merged from daily ones, come within 5 percent of the exact answers."""
    events = table(spark, sf_dir, "events")
    daily = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id").alias("users"))
    merged = daily.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("about"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"), F.percentile_approx("value", 0.5, 10_000).alias("mid"), F.max("value").alias("top"))
    middle = aggregates.exact_median(events, "event_type", "value", "median")
    both = merged.join(exact, "event_type").join(middle, "event_type")
    return both.select("event_type", (F.abs(F.col("about") - F.col("n")) <= 0.05 * F.col("n") + 1).alias("near_distinct"), (F.abs(F.col("mid") - F.col("median")) <= 0.05 * F.col("top")).alias("near_median"))


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) IS NULL AS not_a_number, '{"k":' || json_extract_string(props, '$.k') || '}' AS back
FROM events""")
def json_and_try_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k BIGINT"))
    return events.select("event_id", "p.k", F.col("event_type").try_cast("bigint").isNull().alias("not_a_number"), F.to_json("p").alias("back"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, max(event_id) AS last_id FROM events GROUP BY 1")
def variant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.max("event_id").alias("last_id"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("""
SELECT user_id, count(DISTINCT event_type) AS kinds, max(n) AS most FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def maps_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    kept = F.map_filter("m", lambda k, v: v > 0)
    return maps.select("user_id", F.size(kept).cast("long").alias("kinds"), F.array_max(F.map_values(kept)).alias("most"))


@query("""
SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') = text AS no_digits, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS n_names, regexp_matches(text, 'https?://') AS has_link FROM documents""")
def regular_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", (F.regexp_replace("text", "[0-9]+", "#") == F.col("text")).alias("no_digits"),
        F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).cast("long").alias("n_names"), F.col("text").rlike("https?://").alias("has_link"),
    )


@query("SELECT c_custkey AS k, c_name AS name, NULL AS region FROM customer WHERE c_acctbal < -900 UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return people.unionByName(nations, allowMissingColumns=True).select("k", "name", "region")


@query("""
SELECT event_type, count(*) FILTER (WHERE dayofweek(ts) = 0) AS sunday, count(*) FILTER (WHERE dayofweek(ts) = 1) AS monday, count(*) FILTER (WHERE dayofweek(ts) = 2) AS tuesday,
  count(*) FILTER (WHERE dayofweek(ts) = 3) AS wednesday, count(*) FILTER (WHERE dayofweek(ts) = 4) AS thursday, count(*) FILTER (WHERE dayofweek(ts) = 5) AS friday,
  count(*) FILTER (WHERE dayofweek(ts) = 6) AS saturday
FROM events GROUP BY event_type""")
def whole_week_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
    counts = table(spark, sf_dir, "events").select("event_type", F.dayofweek("ts").alias("d")).groupBy("event_type").pivot("d", list(range(1, 8))).count()
    return counts.select("event_type", *[F.coalesce(f"`{k}`", F.lit(0).cast("long")).alias(n) for k, n in enumerate(names, 1)])


@query("""
WITH marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS started, count(*) AS n FROM numbered GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's closed sessions; those the watermark has not passed stay open."""
    events = windows.event_time(stream(spark, sf_dir, "events"), "ts", "1 hour")
    return windows.run_to_files(windows.session_counts(events, "ts", "30 minutes", "user_id"))


@query("""
WITH w AS (SELECT date_trunc('day', ts) + INTERVAL 12 HOUR * CAST(k AS INT) + INTERVAL 12 HOUR * CAST(extract(HOUR FROM ts) >= 12 AS INT) - INTERVAL 12 HOUR AS started, event_type
FROM events, (SELECT unnest([0, 1]) AS k))
SELECT started, event_type, count(*) AS n FROM w GROUP BY started, event_type HAVING started + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def streamed_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = windows.event_time(stream(spark, sf_dir, "events"), "ts", "1 hour")
    return windows.run_to_files(windows.tumbling(events, "ts", "1 day", ["event_type"], slide="12 hours"))


@query("""
SELECT date_trunc('day', ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2
HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def streamed_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's closed windows; those the watermark has not passed stay open."""
    events = windows.event_time(stream(spark, sf_dir, "events"), "ts", "1 hour")
    return windows.run_to_files(windows.tumbling(events, "ts", "1 day", ["event_type"]))


@query("SELECT user_id, event_type FROM events GROUP BY user_id, event_type")
def streamed_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = windows.event_time(stream(spark, sf_dir, "events"), "ts", "60 days").select("user_id", "event_type", "ts")
    return windows.run_to_files(windows.first_seen(events, ["user_id", "event_type"])).select("user_id", "event_type")


@query("""
SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR
WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def streamed_click_to_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(kind: str, prefix: str) -> DataFrame:
        rows = stream(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{prefix}_id"), F.col("ts").alias(f"{prefix}_ts"))
        return windows.event_time(rows, f"{prefix}_ts", "1 hour")

    pairs = windows.interval_join(side("click", "click"), side("purchase", "purchase"), "user_id", "click_ts", "purchase_ts", "6 hours")
    return windows.run_to_files(pairs).select("click_id", "purchase_id")


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def pipe_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "FROM {orders} |> WHERE o_totalprice > 1000 |> AGGREGATE count(*) AS n, count(DISTINCT o_custkey) AS customers GROUP BY o_orderstatus"
    return spark.sql(text, orders=table(spark, sf_dir, "orders"))


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, len(list(DISTINCT c_mktsegment)) AS n FROM customer GROUP BY c_nationkey")
def listed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of distinct values; a segment is one of a few, so the lists stay short."""
    segments = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("s"))
    return segments.select("c_nationkey", F.array_join(F.array_sort("s"), ",").alias("segments"), F.size("s").cast("long").alias("n"))


@query("SELECT event_type, round(kurtosis_pop(value), 6) AS kurt, round(skewness(value), 6) AS skew FROM events GROUP BY event_type")
def higher_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skewness is the sample's, with its correction for small groups."""
    n = F.count("value")
    skew = F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.kurtosis("value"), 6).alias("kurt"), F.round(skew, 6).alias("skew"))


@query("""
SELECT o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS days, last_day(o_orderdate) AS month_end, CAST(dayofyear(o_orderdate) AS INT) AS doy,
  CAST(weekofyear(o_orderdate) AS INT) AS week, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month, strftime(o_orderdate, '%Y/%m') AS label
FROM orders""")
def date_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.datediff(day, F.lit("1990-01-01").cast("date")).cast("long").alias("days"), F.last_day(day).alias("month_end"), F.dayofyear(day).alias("doy"),
        F.weekofyear(day).alias("week"), F.add_months(day, 1).alias("next_month"), F.date_format("o_orderdate", "yyyy/MM").alias("label"),
    )


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') AS words, len(string_split(p_name, ' ')) AS n,
  list_contains(string_split(p_name, ' '), 'red') AS red, CAST(length(replace(p_name, ' ', '')) AS BIGINT) AS letters FROM part""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    letters = F.aggregate(F.transform(words, lambda w: F.length(w).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("words"), F.size(words).cast("long").alias("n"),
        F.array_contains(words, "red").alias("red"), letters.alias("letters"),
    )


@query("""
SELECT s_suppkey, 'balance' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier
UNION ALL SELECT s_suppkey, 'key', CAST(s_suppkey AS DOUBLE) FROM supplier""")
def inlined_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(name: str, column: str) -> F.Column:
        return F.struct(F.lit(name).alias("name"), F.col(column).cast("double").alias("value"))

    return table(spark, sf_dir, "supplier").select("s_suppkey", F.inline(F.array(named("balance", "s_acctbal"), named("nation", "s_nationkey"), named("key", "s_suppkey"))))


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def rows_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").dropDuplicates(["o_custkey", "o_orderstatus"]).select("o_custkey", "o_orderstatus")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of whole strata, so that the sample is a defined set of rows."""
    return table(spark, sf_dir, "events").sampleBy("event_type", {"click": 1.0, "error": 1.0, "view": 0.0}, seed=5).select("event_id", "event_type")


@query("SELECT true AS about_a_third, true AS without_repeats")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of the rows; the size may be off by six standard deviations."""
    lines = table(spark, sf_dir, "events").select("event_id")
    third = lines.sample(1 / 3, seed=5).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("d")).crossJoin(lines.agg(F.count("*").alias("total")))
    off = F.abs(F.col("n") - F.col("total") / 3)
    return third.select((off <= 6 * F.sqrt(F.col("total") * 2 / 9)).alias("about_a_third"), (F.col("n") == F.col("d")).alias("without_repeats"))


@query("SELECT c_custkey, max(o_totalprice) AS most, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def lateral_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lateral join as a DataFrame; Catalyst turns it into one aggregation and one join."""
    own = table(spark, sf_dir, "orders").where(F.col("o_custkey") == F.col("c_custkey").outer())
    return table(spark, sf_dir, "customer").select("c_custkey").lateralJoin(own.select(F.max("o_totalprice").alias("most"), F.count("o_orderkey").alias("n")))


@F.udtf(returnType="user_id BIGINT, event_type STRING, n BIGINT")
class Streaks:
    """Runs of equal kinds of events of one user, in order of time. Holds one run at a time."""

    def __init__(self) -> None:
        self.run: tuple | None = None
        self.n = 0

    def eval(self, row):  # noqa: ANN001, ANN201
        run = row["user_id"], row["event_type"]
        if run != self.run and self.n:
            yield *self.run, self.n
            self.n = 0
        self.run, self.n = run, self.n + 1

    def terminate(self):  # noqa: ANN201
        if self.n:
            yield *self.run, self.n


@query("""
WITH m AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS g FROM events)
SELECT user_id, event_type, count(*) AS n FROM m GROUP BY user_id, event_type, g""")
def event_streaks_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over partitions in order; it holds one run, so a user may have any number of events."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    return Streaks(events.asTable().partitionBy("user_id").orderBy("ts"))


def _above_balance(_: tuple, customers: pd.DataFrame, orders: pd.DataFrame) -> pd.DataFrame:
    met = customers.merge(orders, left_on="c_custkey", right_on="o_custkey", how="left")
    met["above"] = (met["o_totalprice"] > met["c_acctbal"]).astype("int64")
    return met.groupby("c_custkey", as_index=False, dropna=False, sort=False)["above"].sum()


@query("SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_totalprice > c_acctbal) AS above FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def cogrouped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables by key in pandas, some thousand customers with their orders at a time; one customer's orders are known to be few."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    orders = table(spark, sf_dir, "orders").where("o_custkey is not null").select("o_custkey", "o_totalprice")
    parts = (customers.count() + orders.count()) // 20_000 + 1  # so that a part keeps its size; both counts are read from the files' footers or one column

    def dealt(rows: DataFrame, key: str) -> GroupedData:
        return rows.groupBy(F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(parts))).alias("part"))

    return dealt(customers, "c_custkey").cogroup(dealt(orders, "o_custkey")).applyInPandas(_above_balance, "c_custkey long, above long")


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY user_id")
def streamed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals in a state of the user's own; each batch gives the totals so far, and the last ones stay."""
    totals = windows.running_totals(stream(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")
    last = windows.run_to_files(totals).groupBy("user_id")
    return last.agg(F.max("n").alias("n"), F.max("last_id").alias("last_id"))
