"""Queries through file formats, and over CSV, XML and JSON in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.sources import tables
from sparkloom.sources.scratch import shared_folder
from sparkloom.sources.tables import table

_ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def _through(spark: SparkSession, rows: DataFrame, kind: str, schema: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` written in a format to the shared folder and read back."""
    folder = shared_folder(spark, kind)
    tables.write(rows, folder, kind, partition_by)
    return tables.read(spark, folder, kind, schema)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def orders_through_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, table(spark, sf_dir, "orders"), "csv", _ORDERS)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_totalprice > 1000")
def orders_through_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, table(spark, sf_dir, "orders"), "json", _ORDERS).where("o_totalprice > 1000")


@query("SELECT o_orderpriority, count(*) AS n, max(o_orderdate) AS latest FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def orders_through_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and columns reach the ORC scan."""
    orders = _through(spark, table(spark, sf_dir, "orders"), "orc", _ORDERS)
    return orders.where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name")
def part_names_through_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _through(spark, table(spark, sf_dir, "part").select(F.col("p_name").alias("value")), "text", "value string")
    return lines.groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_returnflag, l_linestatus")
def lines_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written by partition values; the filter picks folders, and only one column is read."""
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus")
    found = _through(spark, lines, "parquet", "l_quantity double, l_returnflag string, l_linestatus string", ("l_returnflag", "l_linestatus"))
    return found.where("l_returnflag <> 'N'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS cust, o_orderstatus AS status, o_totalprice AS price,
  CASE WHEN o_orderkey % 5 = 0 THEN 'c' || o_custkey || ',' || o_orderstatus || ',' || o_orderkey END AS bad
FROM (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS DOUBLE) ELSE CAST(o_custkey AS DOUBLE) / 4 END AS o_totalprice FROM orders)""")
def csv_in_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines in a column. A line with a field of another type keeps its other fields, and stands whole in ``bad``."""
    good = F.concat_ws(",", F.col("o_custkey").cast("string"), "o_orderstatus", (F.col("o_custkey").cast("double") / 4).cast("string"))
    malformed = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(","), "o_orderstatus", F.lit(","), F.col("o_orderkey").cast("string"))
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, malformed).otherwise(good).alias("line"))
    parsed = F.from_csv("line", "cust BIGINT, status STRING, price DOUBLE, bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return lines.select("o_orderkey", parsed.alias("p")).select("o_orderkey", "p.cust", "p.status", "p.price", "p.bad")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey END AS nation, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 6 = 0 THEN '<c><nation>' || c_nationkey || '</c>' END AS bad FROM customer""")
def xml_in_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML in a column. An element that is not well-formed is null, and stands whole in ``bad``."""
    nation = F.concat(F.lit("<c><nation>"), F.col("c_nationkey").cast("string"))
    whole = F.concat(nation, F.lit("</nation><segment>"), "c_mktsegment", F.lit("</segment></c>"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 6 == 0, F.concat(nation, F.lit("</c>"))).otherwise(whole).alias("x"))
    parsed = F.from_xml("x", "nation INT, segment STRING, bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return rows.select("c_custkey", parsed.alias("p")).select("c_custkey", "p.nation", "p.segment", "p.bad")


@query("""
SELECT CASE event_id % 4 WHEN 0 THEN 'OBJECT<k: BIGINT>' WHEN 1 THEN 'OBJECT<k: STRING>' WHEN 2 THEN 'ARRAY<BIGINT>' ELSE 'none' END AS shape, count(*) AS n,
  sum(CASE WHEN event_id % 4 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END)::BIGINT AS total FROM events GROUP BY 1""")
def shapes_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of each JSON value, found from the data; text that is no JSON has none."""
    other = F.when(F.col("event_id") % 4 == 1, F.lit('{"k": "x"}')).when(F.col("event_id") % 4 == 2, F.lit("[1, 2]")).otherwise(F.lit("{broken"))
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 4 == 0, F.col("props")).otherwise(other).alias("j"))
    value = rows.select(F.try_parse_json("j").alias("v"))
    shaped = value.select(F.coalesce(F.schema_of_variant("v"), F.lit("none")).alias("shape"), F.coalesce(F.try_variant_get("v", "$.k", "bigint"), F.lit(0).cast("long")).alias("k"))
    return shaped.groupBy("shape").agg(F.count("*").alias("n"), F.sum("k").alias("total"))
