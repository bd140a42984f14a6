"""A folder that the driver and all executors share, for tables that a query writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new name below ``spark.checkpoint.dir``; below a temporary folder only where that is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="shared-")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
