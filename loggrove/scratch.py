"""Cutting lineage with written tables.

A global order or a score that several later steps read is written once, as
Parquet, below the folder the cluster names in ``spark.checkpoint.dir``. Written
files outlive lost executors, keep column pruning, and carry sizes the optimizer
can check before it broadcasts anything.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _LOCAL_FALLBACK.setdefault(app, tempfile.mkdtemp(prefix="loggrove-"))


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/loggrove/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` once and return a scan of the written table."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
