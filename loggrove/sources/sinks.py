"""Stored tables, CSV exports and topic messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# --- fixed values ----------------------------------------------------------
TABLES = ("structured", "cleaned", "features", "labels", "predictions")
ALERT_TOPIC, DECISION_TOPIC = "alerts", "storage-decisions"


def write_table(frame: DataFrame, root: str, table: str, source: str, mode: str = "overwrite") -> None:
    """Store one source's rows of a table as Parquet, one folder per source, so that
    a reader of one source prunes the others."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}; choose from {', '.join(TABLES)}")
    frame.drop("source").write.mode(mode).parquet(f"{root}/{table}/source={source}")


def read_table(spark: SparkSession, root: str, table: str, source: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{table}")
    return rows if source is None else rows.where(F.col("source") == source)


def export_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def messages(frame: DataFrame, key: str = "block_id") -> DataFrame:
    """Rows as (key, value) messages: JSON values keyed by block, ready for
    ``write.format('kafka')`` with a topic."""
    return frame.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*frame.columns)).alias("value"))
