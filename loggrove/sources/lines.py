"""Raw line input: files, streams and syslog envelopes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loggrove.functions.text import first_group
from loggrove.schema import ARRIVAL_CHUNK, ARRIVAL_SEQ
from loggrove.sources.tail import LINES, SPLIT_BYTES, TailSource

# --- fixed values: syslog envelopes ----------------------------------------
RFC5424 = r"(?s)^<\d{1,3}>1 \S+ \S+ \S+ \S+ \S+ (?:-|(?:\[[^\]]*\])+) ?(.*)$"
RFC3164 = r"(?s)^<\d{1,3}>[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d \S+ [^:\s]+:? ?(.*)$"
BYTE_ORDER_MARK = "\ufeff"


def read_lines(spark: SparkSession, paths: str | list[str], source: str | None = None) -> DataFrame:
    """Text lines with their arrival order: (arrival_chunk, arrival_seq, value).

    A chunk is one file split, named by file and start byte so that chunks sort in
    file order; lines of a split are read in order by one task, so the generated id
    orders them inside it. Only the relative order is meaningful, and that does not
    depend on how splits are packed into tasks. Invalid bytes become U+FFFD.
    """
    lines = spark.read.text(paths).select(
        F.concat_ws("#", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0"))
        .alias(ARRIVAL_CHUNK),
        F.monotonically_increasing_id().alias(ARRIVAL_SEQ),
        F.make_valid_utf8("value").alias("value"),
    )
    return lines if source is None else lines.withColumn("source", F.lit(source))


def _numbered(batches):
    """Lines with a number that grows in the order a task reads them: a stream has no generated row ids."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.arange(number, number + batch.num_rows)), batch.column(1)], [ARRIVAL_CHUNK, ARRIVAL_SEQ, "value"])
        number += batch.num_rows


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same shape from a folder that receives whole files.

    A delivered file is cut into splits like a file of a batch, so a large one is read by many tasks;
    a line that crosses a cut is read once, by the split it begins in. Chunks are splits, as in ``read_lines``.
    """
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    lines = reader.load(path).select(
        F.concat_ws("#", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0")).alias(ARRIVAL_CHUNK),
        F.make_valid_utf8("value").alias("value"))
    return lines.mapInArrow(_numbered, LINES)


def tail_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same shape from files that grow: a chunk is a file, a line's number the byte it begins at.

    See ``sources.tail``. A line is read once its line feed is there.
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format(TailSource.name()).option("splitBytes", str(split_bytes)).load(path)


def topic_for(source: str) -> str:
    return "logs-raw" if source == "hdfs" else f"logs-raw-{source}"


def kafka_lines(spark: SparkSession, source: str, bootstrap_servers: str) -> DataFrame:
    """The same shape from the source's topic, whose messages are keyed by block id.

    Needs the Kafka connector package on the cluster's class path.
    """
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("subscribe", topic_for(source))
        .option("startingOffsets", "earliest")
        .load()
        .select(
            F.concat_ws("#", "topic", F.lpad(F.col("partition").cast("string"), 9, "0")).alias(ARRIVAL_CHUNK),
            F.col("offset").alias(ARRIVAL_SEQ),
            F.make_valid_utf8(F.col("value").cast("string")).alias("value"),
        )
    )


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first n lines in arrival order (a top-n, not a full sort)."""
    order = [c for c in (ARRIVAL_CHUNK, ARRIVAL_SEQ) if c in lines.columns]
    return lines.orderBy(*order).limit(n)


def syslog_message(datagram: Column) -> Column:
    """The message inside an RFC 5424 or RFC 3164 envelope, else null."""
    text = F.rtrim(datagram, F.lit("\r\n\x00"))
    message = F.coalesce(first_group(text, RFC5424), first_group(text, RFC3164))
    return F.nullif(F.trim(F.ltrim(message, F.lit(BYTE_ORDER_MARK)), F.lit("\r\n")), F.lit(""))
