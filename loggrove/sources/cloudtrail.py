"""Nested audit records to structured columns; a block is one identity's hour."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loggrove.sources.records import RecordSource

IDENTITY_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in (
    "type", "principalId", "arn", "accountId", "accessKeyId", "userName")])
RECORD_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "eventTime", "eventSource", "eventName", "sourceIPAddress", "errorCode", "eventID", "awsRegion")]
    + [T.StructField("userIdentity", IDENTITY_SCHEMA)]
)

# --- fixed values ----------------------------------------------------------
EVENT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ACCOUNT_TYPES_WITHOUT_IDENTITY = ("AWSAccount", "Anonymous")


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per record of ``{"Records": […]}`` files; gzip is told by a file's first bytes.

    The record number in its file is the arrival order. A list that breaks off gives the records
    before that; an element that is no record gives one without fields.
    """
    spark.dataSource.register(RecordSource)
    found = spark.read.format(RecordSource.name()).option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).load()
    return found.withColumn("record", F.from_json("value", RECORD_SCHEMA)).drop("value")


def _text(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def identity(record: Column) -> Column:
    """Who made the call; anonymous calls are told apart by address."""
    who = record["userIdentity"]
    kind = F.coalesce(_text(who["type"]), F.lit("Unknown"))
    arn, principal = _text(who["arn"]), _text(who["principalId"])
    anonymous = kind.isin(*ACCOUNT_TYPES_WITHOUT_IDENTITY) & arn.isNull() & principal.isNull()
    named = F.coalesce(
        arn, _text(who["accessKeyId"]), principal,
        F.concat(kind, F.lit(":"), F.coalesce(_text(who["accountId"]), F.lit("unknown"))),
    )
    return F.when(
        anonymous, F.concat(F.lit("anonymous@"), F.coalesce(_text(record["sourceIPAddress"]), F.lit("unknown")))
    ).otherwise(named)


def stages(record: Column) -> list[dict[str, Column]]:
    return [{"_moment": F.try_to_timestamp(record["eventTime"], F.lit(EVENT_TIME_FORMAT))}]


def columns(record: Column) -> dict[str, Column]:
    moment = F.col("_moment")
    parsed = moment.isNotNull()
    error = _text(record["errorCode"])
    return {
        "date": F.date_format(moment, "yyyy-MM-dd"),
        "time": F.date_format(moment, "HH:mm:ss"),
        "pid": F.when(parsed, F.lit(0).cast("bigint")),
        "log_level": F.when(parsed, F.when(error.isNotNull(), F.lit("ERROR")).otherwise(F.lit("INFO"))),
        "component": F.when(parsed, record["eventSource"]),
        "event_type": F.when(parsed, record["eventName"]).otherwise(F.lit("OTHER")),
        "block_id": F.when(parsed, F.concat(identity(record), F.lit("|"), F.date_format(moment, "yyyyMMdd'T'HH"))),
        "source_ip": F.when(parsed, record["sourceIPAddress"]),
        "destination_ip": F.lit(None).cast("string"),
        "block_size": F.lit(None).cast("bigint"),
        "raw_message": F.when(
            parsed,
            F.concat(F.lit("eventID="), F.coalesce(record["eventID"], F.lit("None")),
                     F.lit(" errorCode="), F.coalesce(error, F.lit("-"))),
        ).otherwise(F.substring(F.to_json(record), 1, 200)),
    }
