"""Joins that Spark has no operator for, as compositions of equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], bucket: str = "day") -> DataFrame:
    """Each left row with the ``values`` of the latest right row of its ``key`` that is not later.

    Rows are dealt by key and time bucket, so a key with very many rows spreads over
    many tasks; only one row for each key and bucket is carried on to later buckets.
    Left rows without a match (or with a null key or time) get nulls. Of right rows
    with equal time the one of greatest values counts. Columns: ``left``'s, then ``values``.
    """
    picked = F.struct(F.col(right_time).alias("_t"), *[F.col(v) for v in values])
    rows = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("_key"), F.date_trunc(bucket, right_time).alias("_bucket"), picked.alias("_right"))
    ends = rows.groupBy("_key", "_bucket").agg(F.max("_right").alias("_right"))
    kind = rows.schema["_right"].dataType
    asked = left.select(
        F.col(key).alias("_key"), F.date_trunc(bucket, left_time).alias("_bucket"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"),
        F.lit(None).cast(kind).alias("_right"), F.struct(*left.columns).alias("_left"),
    )
    offers = rows.select("_key", "_bucket", F.col("_right._t").alias("_t"), F.lit(0).alias("_side"), "_right", F.lit(None).cast(asked.schema["_left"].dataType).alias("_left"))
    inside = Window.partitionBy("_key", "_bucket").orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionAll(offers).withColumn("_right", F.last("_right", ignorenulls=True).over(inside)).where("_side = 1")

    wanted = asked.select("_key", "_bucket").distinct().withColumn("_right", F.lit(None).cast(kind))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.unionAll(wanted).groupBy("_key", "_bucket").agg(F.max("_right").alias("_right"))
        .select("_key", "_bucket", F.last("_right", ignorenulls=True).over(before).alias("_earlier"))
    )
    both = found.join(carried, ["_key", "_bucket"], "left").withColumn("_right", F.coalesce("_right", "_earlier"))
    return both.select(*[F.col(f"_left.`{c}`").alias(c) for c in left.columns], *[F.col(f"_right.`{v}`").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with ``low <= point < high``, by an equi-join on cells of ``width`` instead of a nested loop.

    A range is repeated once for each cell that it touches, so ``width`` should be about
    the usual length of a range. Null points and bounds match nothing.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    spread = ranges.where(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("_cell", cell(point)).join(spread, "_cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_cell")


def not_in(rows: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """``rows`` whose ``column`` is ``NOT IN (others.other)``, with SQL's rules for nulls, but without broadcasting ``others``.

    Of ``others`` only the distinct values are exchanged, and two flags (is it empty, does it
    hold a null) are counted beforehand. Nothing is left if ``others`` holds a null; everything
    if it is empty; else rows with a null in ``column`` go.
    """
    flags = others.agg(F.count("*").alias("_n"), F.count_if(F.col(other).isNull()).alias("_nulls"))
    values = others.select(F.col(other).alias("_other")).where("_other is not null").distinct()
    left = rows.join(values, F.col(column) == F.col("_other"), "left_anti")
    return left.crossJoin(F.broadcast(flags)).where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())).drop("_n", "_nulls")


def range_counts(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """``events`` with ``n``: rows of their ``key`` from ``seconds`` before up to their time, ties included.

    Rows are dealt by key and time bucket of that length. A row looks back into one earlier bucket
    at most, so each is also handed, as a mere time, to the next one; no task holds a whole key.
    Rows with a null time count 0.
    """
    second = F.unix_micros(F.col(time).cast("timestamp"))
    length = seconds * 1_000_000
    timed = events.withColumn("_t", second).withColumn("_bucket", F.floor(F.col("_t") / length))
    own = timed.select(F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("_row"), F.col(key).alias("_key"), "_t", "_bucket")
    ahead = own.where("_t is not null").select(F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), "_key", "_t", (F.col("_bucket") + 1).alias("_bucket"))
    frame = Window.partitionBy("_key", "_bucket").orderBy("_t").rangeBetween(-length, 0)
    counted = own.union(ahead).withColumn("_n", F.when(F.col("_t").isNull(), 0).otherwise(F.count("*").over(frame)))
    return counted.where("_row is not null").select(*[F.col(f"_row.`{c}`").alias(c) for c in events.columns], F.col("_n").alias("n"))


def salted_join(big: DataFrame, small: DataFrame, on: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are split: ``big``'s rows are dealt over ``salts`` numbers, ``small``'s are repeated for each.

    The numbers follow the rows' places within their partitions, so equal rows are split too.
    Both sides are exchanged and sorted: the planner takes ``small`` for its size before it is repeated, so it
    would broadcast, by way of the driver, ``salts`` times as many rows as it means to.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep the big side's rows can be salted")
    left = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right.hint("merge"), [on, "_salt"], how).drop("_salt")


def planned_bytes(rows: DataFrame) -> int:
    """What Spark takes the size of ``rows`` for: file sizes, cut by pruned columns; a huge number where nothing is known."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", limit: int = 64 << 20, rows_limit: int = 1_000_000) -> DataFrame:
    """Equi-join whose strategy follows the sides' sizes, read before a hint is given.

    A side is broadcast only if its planned size is within ``limit`` and, as files may be packed many times smaller
    than their rows, a count that stops at ``rows_limit`` finds no more rows than that. Else, if one side's planned size is
    a fifth of the other's or less, hash tables of its partitions are built (shuffle hash); else both are sorted (merge),
    which needs no memory for either. Sides that an outer join must keep are never broadcast.
    """
    sizes = {"left": planned_bytes(left), "right": planned_bytes(right)}
    may = {"inner": ("left", "right"), "cross": (), "full": (), "full_outer": (), "fullouter": (), "outer": (), "right": ("left",), "right_outer": ("left",), "rightouter": ("left",)}.get(how, ("right",))
    sides = {"left": left, "right": right}
    for side in sorted(may, key=lambda s: sizes[s]):
        if sizes[side] <= limit and sides[side].limit(rows_limit + 1).count() <= rows_limit:
            sides[side] = F.broadcast(sides[side])
            return sides["left"].join(sides["right"], on, how)
    smaller = min(may, key=lambda s: sizes[s], default=None)
    larger = max(sizes.values())
    if smaller and sizes[smaller] * 5 <= larger:
        sides[smaller] = sides[smaller].hint("shuffle_hash")
    else:
        sides["right"] = sides["right"].hint("merge")
    return sides["left"].join(sides["right"], on, how)
