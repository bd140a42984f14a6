"""Sketches that merge: a table of small states by group, from which coarser groups are answered without the rows.

Distinct integers as bitmaps are exact. Theta sketches answer set expressions over distinct values, exactly up to
``2 ** lg_k`` of them and with a relative standard error of about ``2 ** (-lg_k / 2)`` beyond; KLL sketches answer quantiles
within about ``1.65 / k ** 0.9`` of the rows in rank (1.3 percent at 200), exactly up to some ``k`` rows; HyperLogLog counts distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmaps(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, bucket, bits``: the distinct non-null integers of each group, 32,768 of the number line to a row of 4 KB."""
    kept = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("long").alias("_v"))
    return kept.groupBy(*by, F.bitmap_bucket_number("_v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_v")).alias("bits"))


def merged_bitmaps(maps: DataFrame, by: list[str], every: bool = False) -> DataFrame:
    """Bitmaps of coarser groups: values of any part, or only those that are in every part that has the bucket."""
    merge = F.bitmap_and_agg if every else F.bitmap_or_agg
    return maps.groupBy(*by, "bucket").agg(merge("bits").alias("bits"))


def bitmap_counts(maps: DataFrame, by: list[str], name: str) -> DataFrame:
    """Exact distinct counts; a group spreads over as many tasks as it has buckets before its numbers are added up."""
    return maps.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).cast("long").alias(name))


def summaries(rows: DataFrame, by: list[str], value: str, measure: str, lg_k: int = 14, k: int = 400) -> DataFrame:
    """``by, theta, hll, kll``: sketches of ``value``'s distinct values and of ``measure``'s distribution. Null values, and NaN measures, are left out."""
    real = F.when(~F.isnan(measure), F.col(measure).cast("double"))
    return rows.groupBy(*by).agg(
        F.theta_sketch_agg(F.col(value).cast("long"), lg_k).alias("theta"), F.hll_sketch_agg(F.col(value).cast("long"), lg_k).alias("hll"), F.kll_sketch_agg_double(real, k).alias("kll")
    )


def merged_summaries(parts: DataFrame, by: list[str], lg_k: int = 14, k: int = 400) -> DataFrame:
    """The same of coarser groups, from the sketches alone."""
    return parts.groupBy(*by).agg(F.theta_union_agg("theta", lg_k).alias("theta"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll", k).alias("kll"))


def about(sketch: Column | str) -> Column:
    """Distinct values of a theta sketch, as a number of the nearest integer."""
    return F.round(F.theta_sketch_estimate(sketch)).cast("long")


def in_both(a: Column | str, b: Column | str) -> Column:
    return about(F.theta_intersection(a, b))


def in_either(a: Column | str, b: Column | str, lg_k: int = 14) -> Column:
    return about(F.theta_union(a, b, lg_k))


def only_in_first(a: Column | str, b: Column | str) -> Column:
    return about(F.theta_difference(a, b))


def quantiles(sketch: Column | str, shares: list[float]) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(s)) for s in shares]))


def rows_seen(sketch: Column | str) -> Column:
    """The exact number of values that a KLL sketch has taken."""
    return F.kll_sketch_get_n_double(sketch)
