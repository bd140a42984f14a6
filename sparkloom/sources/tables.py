"""Reading and writing tables: parquet, ORC, JSON lines, CSV and text, in batches or as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table of one of FORMATS. CSV and JSON should be given a schema: inferring one reads all data twice."""
    if kind not in FORMATS:
        raise ValueError(f"one of {FORMATS} is needed")
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


#: Of one partition value in one task of a write; a task sorts its rows by partition values before it writes them.
PIECE_ROWS = 1_000_000


def _together(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows of one value of ``by`` in one task, or in as many as they make pieces of ``PIECE_ROWS``.

    Spark's own rebalancing goes by bytes as compressed, of which columns that hold few values have next to none for a
    row, so a task could hold very many rows. Values are few, as each is a folder; their counts are broadcast.
    """
    parts = rows.count() // PIECE_ROWS + 1
    if parts == 1:
        return rows.hint("rebalance", *by)
    own = [f"_own{i}" for i in range(len(by))]
    counts = rows.groupBy(*[F.col(c).alias(o) for c, o in zip(by, own)]).agg(F.ceil(F.count("*") / PIECE_ROWS).alias("_pieces"))
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(by, own)]
    dealt = rows.join(F.broadcast(counts), same).withColumn("_piece", F.pmod(F.monotonically_increasing_id(), F.col("_pieces")))
    return dealt.repartition(4 * parts, *by, "_piece").select(*rows.columns)


def write(rows: DataFrame, path: str, kind: str, partition_by: tuple[str, ...] = (), mode: str = "error", **options: str) -> None:
    """Writes ``rows``; rows of one partition value are brought together first, split where there are very many."""
    if kind not in FORMATS:
        raise ValueError(f"one of {FORMATS} is needed")
    rows = _together(rows, partition_by) if partition_by else rows
    rows.write.options(**({"header": "true"} if kind == "csv" else {}), **options).partitionBy(*partition_by).mode(mode).format(kind).save(path)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, with the schema of what is there.

    The table is one file or a directory of part files, plain or by partition values.
    The path is a pattern that matches only its own name, as Spark takes a file or a directory there.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("basePath", sf_dir).parquet(f"{sf_dir}/{name}.parque[t]")
