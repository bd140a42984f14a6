"""Event-time operators on streams. Event times are cast to ``timestamp``, as watermarks need; sessions run in UTC."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.sources.scratch import shared_folder


def event_time(events: DataFrame, time: str, delay: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts by window and keys; sliding windows if ``slide`` is given."""
    return events.groupBy(F.window(time, size, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("started"), *keys, "n")


def session_counts(events: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    return events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys`` within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str) -> DataFrame:
    """Pairs of one key in which the right row comes at most ``within`` later; both sides need watermarks."""
    bounds = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"interval {within}"))
    return left.join(right, (left[key] == right[key]) & bounds).drop(right[key])


def running_totals(events: DataFrame, key: str, number: str) -> DataFrame:
    """``key, n, last_id``: rows so far and the largest ``number`` of each key, after each batch.

    The state of a key is two numbers; a batch of a key arrives in slices, so its size is not bounded by memory.
    """

    def step(keys: tuple, slices: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        for rows in slices:
            n += len(rows)
            top = rows[number].max()
            last = last if pd.isna(top) else int(top) if last is None else max(last, int(top))
        state.update((n, last))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "last_id": pd.array([last], "Int64")})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, last_id long", "n long, last_id long", "append", GroupStateTimeout.NoTimeout)


def run_to_files(rows: DataFrame) -> DataFrame:
    """Runs a stream over all that is there, into files of the shared checkpoint folder, and reads them back.

    Without ``spark.checkpoint.dir`` a temporary folder is used where all runs in one process; on a cluster that is an error.
    """
    spark: SparkSession = rows.sparkSession
    folder = shared_folder(spark, "stream")
    _to_files(rows, folder).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def run_limited_to_files(rows: DataFrame) -> DataFrame:
    """``run_to_files`` for a source that limits its batches and names no end of its own: batch follows batch until one brings nothing new.

    Not for streams with a watermark: what only a later batch would close may be left open.
    """
    spark: SparkSession = rows.sparkSession
    folder = shared_folder(spark, "stream")
    query = _to_files(rows, folder).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def _to_files(rows: DataFrame, folder: str) -> DataStreamWriter:
    return rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").outputMode("append")
