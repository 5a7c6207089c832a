"""Adapters from plain event and order tables to the common log shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loggrove.schema import ARRIVAL_SEQ


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _second(column: Column) -> Column:
    return F.date_trunc("SECOND", column).cast("timestamp_ntz")


def events_log(spark: SparkSession, folder: str, block: str = "user") -> DataFrame:
    """Cleaned-log shape of ``events``. ``block`` is 'user', 'identity_hour' or 'window'."""
    events = read_table(spark, folder, "events").withColumn("k", _k())
    user = F.concat(F.lit("user-"), F.col("user_id"))
    stamp = F.col("ts").cast("timestamp")
    blocks = {
        "user": user,
        "identity_hour": F.concat(user, F.lit("|"), F.date_format("ts", "yyyyMMdd'T'HH")),
        "window": F.concat(F.lit("win-"), F.date_format(
            F.timestamp_seconds(F.unix_seconds(stamp) - F.pmod(F.unix_seconds(stamp), F.lit(60))), "yyyyMMdd'T'HHmmss")),
    }
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").cast("bigint").alias(ARRIVAL_SEQ),
        _second(F.col("ts")).alias("datetime"),
        blocks[block].alias("block_id"),
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO").alias("log_level"),
        F.concat(F.lit("svc-"), F.col("k") % 5).alias("component"),
        kind.alias("event_type"),
        F.concat(F.lit("10.0."), F.col("user_id") % 7, F.lit("."), F.col("k") % 20).alias("source_ip"),
        F.when(kind == "purchase", F.concat(F.lit("10.1.0."), F.col("k") % 10)).alias("destination_ip"),
        F.when(kind == "purchase", F.floor("value").cast("bigint")).alias("block_size"),
        F.concat(kind, F.lit(" k="), F.col("k")).alias("raw_message"),
    )


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned-log shape of ``lineitem``: many small blocks, no arrival order."""
    items = read_table(spark, folder, "lineitem")
    return items.select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("datetime"),
        F.concat(F.lit("blk_"), F.col("l_orderkey")).alias("block_id"),
        F.when(F.col("l_discount") >= 0.095, "ERROR").when(F.col("l_tax") >= 0.075, "WARN").otherwise("INFO").alias("log_level"),
        F.concat(F.lit("svc-"), F.col("l_suppkey") % 7).alias("component"),
        F.concat("l_returnflag", "l_linestatus").alias("event_type"),
        F.concat(F.lit("10.2.0."), F.col("l_partkey") % 50).alias("source_ip"),
        F.lit(None).cast("string").alias("destination_ip"),
        F.floor("l_quantity").cast("bigint").alias("block_size"),
    )


def structured_events(spark: SparkSession, folder: str) -> DataFrame:
    """Uncleaned structured rows of ``events`` with gaps: some required fields are
    blank, ``<NA>`` or missing, some times are not times, some texts need trimming."""
    events = read_table(spark, folder, "events").withColumn("k", _k())
    kind, k = F.col("event_type"), F.col("k")
    return events.select(
        F.col("event_id").cast("bigint").alias(ARRIVAL_SEQ),
        F.when(k == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd"))).alias("date"),
        F.when(k == 1, F.lit("25:61:00")).otherwise(F.date_format("ts", "HH:mm:ss")).alias("time"),
        F.when(k == 2, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("pid"),
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO").alias("log_level"),
        F.when(k == 3, F.lit("  ")).when(k == 4, F.lit("<NA>"))
        .otherwise(F.concat(F.lit(" svc-"), k % 5, F.lit(" "))).alias("component"),
        kind.alias("event_type"),
        F.when(k == 5, F.lit(None)).otherwise(F.concat(F.lit("user-"), F.col("user_id"))).alias("block_id"),
        F.when(k == 6, F.lit("")).when(k == 7, F.lit("<NA>"))
        .otherwise(F.concat(F.lit("10.0."), F.col("user_id") % 7, F.lit("."), k % 20)).alias("source_ip"),
        F.when(kind == "purchase", F.concat(F.lit("10.1.0."), k % 10)).alias("destination_ip"),
        F.when(kind == "purchase", F.floor("value").cast("string")).when(kind == "view", F.lit("x")).alias("block_size"),
        F.concat(kind, F.lit(" k="), k).alias("raw_message"),
    )


def twice(frame: DataFrame) -> DataFrame:
    """Every row delivered a second time, later."""
    later = frame.withColumn(ARRIVAL_SEQ, F.col(ARRIVAL_SEQ) + F.lit(1_000_000_000_000).cast("bigint"))
    return frame.unionByName(later)
