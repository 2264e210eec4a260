"""The shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder name under spark.checkpoint.dir; with a local master a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="vecloom-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
