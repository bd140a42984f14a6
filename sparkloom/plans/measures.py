"""Queries over sketches, samples, frequent values, quantiles, measured joins and exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import frequent, joins, nearest, sampling, sketching
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

_PLACE = "CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"


@query("""
WITH pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))) AS d
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INT) AS rank, vec_id, round(d, 9) AS score FROM pairs
QUALIFY rank <= 10""")
def exact_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set (ids divisible by 100) against all vectors, in blocks."""
    vectors = table(spark, sf_dir, "embeddings")
    found = nearest.exact_nearest(vectors.where("vec_id % 100 = 0"), vectors, 10)
    return found.withColumn("score", F.round("score", 9))


@query("""
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE value > 90) AS users_high,
  count(DISTINCT user_id) FILTER (WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)) AS never_bought
FROM events GROUP BY event_type""")
def bitmap_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts from daily bitmaps, merged; users who never bought are those of the union with the buyers, less the buyers."""
    events = table(spark, sf_dir, "events")
    daily = sketching.bitmaps(events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id")
    merged = sketching.merged_bitmaps(daily, ["event_type"])
    high = sketching.bitmap_counts(sketching.bitmaps(events.where("value > 90"), ["event_type"], "user_id"), ["event_type"], "users_high")
    buyers = merged.where("event_type = 'purchase'").select("bucket", "bits")
    kinds = merged.select("event_type").distinct()
    either = sketching.merged_bitmaps(merged.unionByName(kinds.crossJoin(buyers)), ["event_type"])  # a few kinds, each with the buyers' bitmaps
    plain = sketching.bitmap_counts(merged, ["event_type"], "users")
    both = sketching.bitmap_counts(either, ["event_type"], "either").crossJoin(buyers.agg(F.sum(F.bitmap_count("bits")).cast("long").alias("bought")))
    rows = events.groupBy("event_type").agg(F.count("*").alias("n"))
    joined = rows.join(plain, "event_type").join(high, "event_type", "left").join(both, "event_type")
    return joined.select("event_type", "n", "users", F.coalesce("users_high", F.lit(0).cast("long")).alias("users_high"), (F.col("either") - F.coalesce("bought", F.lit(0).cast("long"))).alias("never_bought"))


@query("""
WITH u AS (SELECT DISTINCT event_type, user_id FROM events), b AS (SELECT user_id FROM u WHERE event_type = 'purchase'),
sets AS (SELECT event_type, count(*) AS users, count(*) FILTER (WHERE user_id IN (SELECT user_id FROM b)) AS also_bought FROM u GROUP BY event_type)
SELECT event_type, users, also_bought, users + (SELECT count(*) FROM b) - also_bought AS or_bought, users - also_bought AS not_bought, n, low, high, true AS mid_in_rank
FROM sets JOIN (SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY event_type) USING (event_type)""")
def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily theta and KLL sketches, merged, and set expressions over them. Up to 16,384 users the numbers are exact; the ranks of the
    quartiles are counted exactly and must be within 2 percent (``mid_in_rank``)."""
    events = table(spark, sf_dir, "events")
    daily = sketching.summaries(events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id", "value")
    merged = sketching.merged_summaries(daily, ["event_type"])
    buyers = merged.where("event_type = 'purchase'").select(F.col("theta").alias("bought"))
    both = merged.crossJoin(F.broadcast(buyers))  # one row
    shares = [0.25, 0.5, 0.75]
    marks = both.select(
        "event_type", sketching.about("theta").alias("users"), sketching.in_both("theta", "bought").alias("also_bought"), sketching.in_either("theta", "bought").alias("or_bought"),
        sketching.only_in_first("theta", "bought").alias("not_bought"), sketching.rows_seen("kll").alias("n"), sketching.quantiles("kll", [0.0, *shares, 1.0]).alias("q"),
    )
    below = [F.count_if(F.col("value") < F.col("q")[i + 1]).alias(f"b{i}") for i in range(3)] + [F.count_if(F.col("value") <= F.col("q")[i + 1]).alias(f"u{i}") for i in range(3)]
    ranks = events.join(F.broadcast(marks.select("event_type", "q")), "event_type").groupBy("event_type").agg(*below)
    within = F.lit(True)
    for i, share in enumerate(shares):
        within = within & (F.col(f"b{i}") <= (share + 0.02) * F.col("n")) & (F.col(f"u{i}") >= (share - 0.02) * F.col("n"))
    return marks.join(ranks, "event_type").select(
        "event_type", "users", "also_bought", "or_bought", "not_bought", "n", F.col("q")[0].alias("low"), F.col("q")[4].alias("high"), within.alias("mid_in_rank")
    )


@query("""
SELECT 'supplier' AS what, l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 0.0105 * (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'quantity', CAST(l_quantity AS BIGINT), count(*) FROM lineitem GROUP BY l_quantity HAVING count(*) > 0.0199 * (SELECT count(*) FROM lineitem)""")
def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("l_quantity"))
    parts = [frequent.heavy_hitters(lines, c, share).select(F.lit(what).alias("what"), F.col(c).alias("k"), "n") for what, c, share in (("supplier", "l_suppkey", 0.0105), ("quantity", "l_quantity", 0.0199))]
    return parts[0].unionByName(parts[1])


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P"
FROM orders GROUP BY o_orderpriority""")
def contingency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.contingency(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("""
WITH s AS (SELECT unnest([0.1, 0.5, 0.9, 0.99]) AS share)
SELECT event_type, CAST(share AS DOUBLE) AS share, count(value) AS n, true AS in_rank FROM events, s GROUP BY event_type, share""")
def near_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate quantiles whose exact rank is counted; ``in_rank`` says that it is within the stated half percent."""
    found = frequent.near_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.1, 0.5, 0.9, 0.99], 0.005)
    n = F.col("n")
    return found.select("event_type", "share", "n", ((F.col("below") <= (F.col("share") + 0.005) * n) & (F.col("up_to") >= (F.col("share") - 0.005) * n)).alias("in_rank"))


@query(f"SELECT event_id, user_id FROM events WHERE {_PLACE.format(seed=5, key='event_id')} < 1431655765")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows, by hash."""
    return sampling.hashed_sample(table(spark, sf_dir, "events"), "event_id", 1 / 3, 5).select("event_id", "user_id")


@query(f"""
SELECT event_id, event_type FROM events
WHERE {_PLACE.format(seed=9, key='event_id')} < CASE event_type WHEN 'click' THEN 2147483648 WHEN 'error' THEN 429496730 WHEN 'purchase' THEN 4294967296 ELSE 0 END""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the clicks, a tenth of the errors, all purchases and nothing else."""
    return sampling.hashed_strata(table(spark, sf_dir, "events"), "event_id", "event_type", {"click": 0.5, "error": 0.1, "purchase": 1.0}, 9).select("event_id", "event_type")


@query("""
SELECT c_mktsegment, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name""")
def joined_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each join's strategy follows the measured sizes of its sides."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    placed = joins.sized_join(joins.sized_join(orders, people, "c_custkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return placed.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT o_orderpriority, quantile_cont(o_totalprice, 0.9) AS p90, mode(o_orderstatus) AS usual, any_value(o_orderpriority) AS any_priority, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses
FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS c FROM orders) GROUP BY o_orderpriority""")
def percentiles_and_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.percentile("o_totalprice", 0.9).alias("p90"), F.mode("o_orderstatus").alias("usual"), F.any_value("o_orderpriority").alias("any_priority"),
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "|").alias("statuses"),
    )
