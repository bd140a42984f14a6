"""Aggregations that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, salts: int = 16) -> DataFrame:
    """The first ``k`` rows of each group; every group is cut to ``salts`` times ``k`` rows before it meets in one task."""
    parted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    for keys in ([*by, "_salt"], by):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        parted = parted.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")
    return parted.drop("_salt")


def exact_distinct(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``count(distinct value)`` for each group in two steps, so that no task holds all values of a hot group."""
    return rows.groupBy(*by, value).agg(F.lit(1).alias("_one")).groupBy(*by).agg(F.count(F.col(value)).alias(name))


def exact_median(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """The exact median of each group without holding a group's values in one task.

    Equal values are counted first. The counts of a group are ranked by a running sum over
    (group, range of values) cells: cell totals are summed up (one row a cell), and within a
    cell the sum runs over its own values. The two middle ranks are then averaged.
    Null values are left out; groups without values get no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    bounds = counts.groupBy("_g").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_c").alias("_all"))
    cell = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * 1000)).otherwise(0)
    celled = counts.join(bounds, "_g").withColumn("_cell", cell)
    totals = celled.groupBy("_g", "_cell").agg(F.sum("_c").alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(Window.partitionBy("_g").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_g", "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = celled.join(before, ["_g", "_cell"]).withColumn("_end", F.col("_before") + F.sum("_c").over(inside)).withColumn("_begin", F.col("_end") - F.col("_c"))
    middle = lambda rank: F.max(F.when((F.col("_begin") < rank) & (F.col("_end") >= rank), F.col("_v")))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    return ranked.groupBy(F.col("_g").alias(by)).agg(((middle(low) + middle(high)) / 2).alias(name))


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """``key, started, ended, n``: runs of events whose neighbours are less than ``gap`` apart, by Spark's session windows."""
    return events.groupBy(key, F.session_window(time, gap).alias("_w")).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n")).drop("_w")
