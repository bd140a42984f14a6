"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not root and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="checkpoint-"))
    return root or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder; its lineage ends there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It deletes them when the driver collects garbage, which a driver with little to do may put off
    until a loop of small steps has filled the disk.
    """
    spark.sparkContext._jvm.System.gc()


def placed(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` computed once and kept as a table in the shared checkpoint folder, and that table's folder.

    Its lineage ends there. Unlike a checkpoint, the last stage runs once, and small files are read
    together, so a loop of small steps over many partitions needs far fewer tasks. ``removed`` frees
    the disk when a later step has taken the table's place.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_root(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def written(df: DataFrame) -> DataFrame:
    """The table of ``placed`` alone, for results that stay."""
    return placed(df)[0]


def removed(spark: SparkSession, *folders: str) -> None:
    """Deletes tables that ``placed`` made."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], text_at: int = 1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` text bytes each (one longer text stands alone)."""
    for batch in batches:
        column = batch.column(text_at)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        begin = total = 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        if begin < len(sizes):
            yield batch.slice(begin)


def kept_columns(df: DataFrame, keep: tuple[str, ...]) -> tuple[list[Column], str]:
    """``keep`` under plain names that clash with nothing, and their schema as it follows other fields."""
    kinds = dict(df.dtypes)
    return [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], "".join(f", _k{i} {kinds[c]}" for i, c in enumerate(keep))


def named_back(keep: tuple[str, ...]) -> list[Column]:
    return [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used`` and the whole row as one column ``_row``, so that no other name can clash."""
    return docs.select(*[F.col(f"`{c}`") for c in used], F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(docs.columns)]).alias("_row"))


def unpacked(found: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that ``packed`` put away, under their own names."""
    return found.select(*[F.col(f"_row.f{i}").alias(c) for i, c in enumerate(columns)])
