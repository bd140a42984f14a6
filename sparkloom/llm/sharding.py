"""Contiguous shards of near-equal bytes.

Rows are put in order by a range exchange of three small columns, the bytes of
each range partition are summed, and the exclusive prefix sums of those totals
(one row a partition) give every partition its place on the global byte line.
A running sum inside the partition then places each row, and the line is cut at
``n_shards`` equal targets: a row belongs to the shard its midpoint falls in.

Defined cases: a null text counts one byte, like an empty one; repeated rows
and equal ids keep separate places; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the row number and the bytes before each row, counted within the partition."""
    rows = total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        ends = total + np.cumsum(sizes)
        number = np.arange(rows, rows + len(sizes), dtype=np.int64)
        rows, total = rows + len(sizes), int(ends[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(number), pa.array(ends - sizes)],
            names=[*batch.schema.names, "_row", "_before"],
        )


def byte_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, shard, slot``: shards are contiguous in ``id_col`` and near equal in bytes.

    The largest deviation of a shard from the mean is one row's size.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.col(text_col)
    small = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("_tie", F.monotonically_increasing_id())
    # The size and checksum are computed once, not once more for the sampling of the range exchange.
    small = cut(small)
    spread = small.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = small.repartitionByRange(int(spread), id_col, "_tie").sortWithinPartitions(id_col, "_tie")
    placed = cut(placed.mapInArrow(_running, f"{id_col} {dict(docs.dtypes)[id_col]}, size long, text_crc32 long, _tie long, _row long, _before long").drop("_tie").withColumn("_part", F.spark_partition_id()))

    # One row a partition, so the single-task window and the broadcast are bounded by the partition count.
    totals = placed.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_row0"),
        F.sum("_bytes").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    middle = F.col("_byte0") + F.col("_before") + F.expr("size div 2")
    shard = F.least(F.lit(n_shards - 1), F.floor(middle.cast("double") * n_shards / F.col("_all"))).cast("int")
    at = placed.join(F.broadcast(offsets), "_part").select(
        id_col, "size", "text_crc32", shard.alias("shard"), (F.col("_row0") + F.col("_row")).alias("_at")
    )
    firsts = at.groupBy("shard").agg(F.min("_at").alias("_first"))  # at most n_shards rows
    return at.join(F.broadcast(firsts), "shard").select(
        id_col, "size", "text_crc32", "shard", (F.col("_at") - F.col("_first")).alias("slot")
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes whole rows of ``docs`` under ``path/shard=N``; ids must be unique."""
    placed = docs.join(shards.select(id_col, "shard", "slot"), id_col)
    placed.write.partitionBy("shard").parquet(path)
