"""Output modes and sinks: a whole result after each batch, and a keyed table that batches are merged into."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from sparkloom.sources.scratch import shared_folder


def _ended(query: StreamingQuery) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


def complete_in_memory(rows: DataFrame) -> DataFrame:
    """Runs an aggregation over all that is there in complete mode and returns its last whole result, by the memory sink.

    The result is held by the driver: for few groups only. ``merged`` is the way for many.
    """
    spark = rows.sparkSession
    name = f"whole_{uuid.uuid4().hex}"
    writer = rows.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", shared_folder(spark, "stream"))
    _ended(writer.trigger(availableNow=True).start())
    return spark.table(name)


class KeyedTable:
    """A table with one row for each key, in the shared folder, into which batches are merged.

    Rows are dealt over ``buckets`` by their key; a batch rewrites only the buckets that it touches, as a new
    version under its own number, from the newest version before that number. So a batch that is
    replayed after a failure reads what it read the first time and writes what it wrote: the sink is idempotent. Readers
    take the newest version of each bucket up to the last batch that is marked as committed, so half a batch is never seen.
    """

    def __init__(self, spark: SparkSession, schema: str, keys: list[str], folder: str | None = None, buckets: int = 8):
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.folder = folder or shared_folder(spark, "keyed")
        self.schema = f"{schema}, _bucket int, _version long"
        self.columns = spark.createDataFrame([], schema).columns

    def _read(self, part: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")

    def _newest(self, before: int | None = None) -> DataFrame:
        if before is None:
            before = self._read("committed", "_version long").agg(F.max("_version")).first()[0]
            before = -1 if before is None else before + 1
        rows = self._read("rows", self.schema).where(F.col("_version") < before)
        # Versions are folders, so this reads no column of the data; there is a row for each bucket.
        newest = rows.groupBy("_bucket").agg(F.max("_version").alias("_version"))
        return rows.join(F.broadcast(newest), ["_bucket", "_version"])

    def rows(self) -> DataFrame:
        return self._newest().select(*self.columns)

    def merge(self, batch: DataFrame, version: int) -> None:
        """Rows of ``batch`` take the place of those with equal keys; keys must be unique in it."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = batch.select(*self.columns).withColumn("_bucket", bucket).persist()
        try:
            touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # at most ``buckets``
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
            kept = self._newest(version).where(F.col("_bucket").isin(touched)).alias("o").join(new.alias("n"), same, "left_anti").select(*self.columns, "_bucket")
            whole = kept.unionByName(new).withColumn("_version", F.lit(version).cast("long"))
            if touched:
                whole.repartition(min(self.buckets, len(touched)), "_bucket").write.partitionBy("_bucket", "_version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/rows")
            self.spark.range(version, version + 1).select(F.col("id").alias("_version")).write.mode("overwrite").parquet(f"{self.folder}/committed/batch={version}")
        finally:
            new.unpersist()

    def writer(self, rows: DataFrame, mode: str = "update") -> DataStreamWriter:
        """A stream that merges its batches into this table."""
        start = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{self.folder}/log")
        return start.foreachBatch(lambda batch, number: self.merge(batch, number))


def merged(rows: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    """Runs an aggregation over all that is there in update mode into a keyed table, and reads it back."""
    into = KeyedTable(rows.sparkSession, schema, keys)
    _ended(into.writer(rows).trigger(availableNow=True).start())
    return into.rows()
