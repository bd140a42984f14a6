"""Frequent values, contingency tables and quantiles with known error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def heavy_hitters(rows: DataFrame, column: str, share: float) -> DataFrame:
    """``column, n`` of every value that more than ``share`` of all rows hold, with exact counts, in two passes.

    The first is Misra and Gries' in each task (Spark's ``freqItems``), merged: it finds every value that is frequent
    enough, and others, at most about ``1 / share`` a task; the merged list is cut to as many, which is what reaches the driver. The second
    counts those alone; all else is one group, so each task sends at most ``1 / share`` rows. Nulls are a value like any other.
    """
    found = rows.select(F.col(column).alias("_v")).where("_v is not null").freqItems(["_v"], share).first()["_v_freqItems"] or []
    candidate = F.col("_v").isin(found) if found else F.lit(False)
    counted = rows.select(F.col(column).alias("_v")).select(
        F.when(F.coalesce(candidate, F.lit(False)), F.col("_v")).alias("_v"), F.when(F.col("_v").isNull(), 1).when(candidate, 0).otherwise(2).alias("_kind")
    )
    counts = counted.groupBy("_v", "_kind").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over those few rows
    return counts.withColumn("_all", total).where((F.col("_kind") < 2) & (F.col("n") > share * F.col("_all"))).select(F.col("_v").alias(column), "n")


def contingency(rows: DataFrame, down: str, across: str, most: int = 1000) -> DataFrame:
    """Counts of each value of ``down`` (rows) with each of ``across`` (columns, named by the value; nulls by ``null``).

    Unlike ``crosstab`` only the values of ``across`` reach the driver, which refuses more than ``most``; ``down`` may have any number.
    """
    name = F.coalesce(F.col(across).cast("string"), F.lit("null"))
    values = [r[0] for r in rows.select(name).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{across} has more than {most} values")
    return rows.select(F.col(down).alias("_down"), name.alias("_across")).groupBy("_down").pivot("_across", sorted(values)).count().na.fill(0, sorted(values)).withColumnRenamed("_down", down)


def near_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], error: float) -> DataFrame:
    """``by, share, quantile, below, up_to, n``: quantiles off by at most ``error`` of a group's rows in rank, and how far they are.

    A quantile's exact rank is then counted in a second pass: ``below`` rows are smaller and ``up_to`` not larger. Null and NaN values are left out.
    """
    kept = rows.select(*by, F.col(value).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    keys = [F.col(b).alias(f"_g{i}") for i, b in enumerate(by)]
    # Four times as fine as asked: summaries merged from several tasks, and whole ranks of small groups, go over Spark's own bound.
    found = kept.groupBy(*keys).agg(F.percentile_approx("_x", shares, round(4 / error)).alias("_q"))
    # A row for each group; a group's array goes once to each of its rows.
    marked = kept.join(found, [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)])
    counts = [F.count_if(F.col("_x") < F.col("_q")[i]).alias(f"_b{i}") for i in range(len(shares))] + [F.count_if(F.col("_x") <= F.col("_q")[i]).alias(f"_u{i}") for i in range(len(shares))]
    ranked = marked.groupBy(*by).agg(F.first("_q").alias("_q"), F.count("*").alias("n"), *counts)
    each = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col("_q")[i].alias("quantile"), F.col(f"_b{i}").alias("below"), F.col(f"_u{i}").alias("up_to")) for i, s in enumerate(shares)])
    return ranked.select(*by, "n", F.inline(each))
