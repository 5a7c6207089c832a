"""Model versions as an append-only history table.

One row per event: (at, event, metric, promoted, from_version, to_version, new_version,
current_value, candidate_value, reason). The live version follows from the newest row
that moves it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

HISTORY_SCHEMA = T.StructType([
    T.StructField("at", T.TimestampNTZType()), T.StructField("event", T.StringType()), T.StructField("metric", T.StringType()),
    T.StructField("promoted", T.BooleanType()), T.StructField("from_version", T.IntegerType()), T.StructField("to_version", T.IntegerType()),
    T.StructField("new_version", T.IntegerType()), T.StructField("current_value", T.DoubleType()),
    T.StructField("candidate_value", T.DoubleType()), T.StructField("reason", T.StringType()),
])

# --- fixed values ----------------------------------------------------------
HEALTHY_F1 = 0.40
FIRST_VERSION = 1


def decide(current_version: int, current_value: float, candidate_value: float, issued: list[int]) -> dict:
    """Promote iff strictly better; a new version is one past the highest ever issued."""
    promoted = candidate_value > current_value
    return {"promoted": promoted, "new_version": max([current_version, *issued]) + 1 if promoted else None}


def live_version(history: DataFrame, by: list[str] = ()) -> DataFrame:
    """The version in service: the target of the newest promotion or override."""
    target = F.when(F.col("promoted"), F.col("new_version")).when(
        F.col("event").isin("rollback", "manual_promotion"), F.col("to_version"))
    moves = history.withColumn("_target", target)
    return moves.groupBy(*by).agg(
        F.coalesce(F.max_by("_target", F.when(F.col("_target").isNotNull(), F.col("at"))), F.lit(FIRST_VERSION)).alias("version"))


def next_version(history: DataFrame, by: list[str] = ()) -> DataFrame:
    """One past the highest version ever issued, whatever is live now."""
    return history.groupBy(*by).agg(
        (F.greatest(F.coalesce(F.max("new_version"), F.lit(FIRST_VERSION)), F.lit(FIRST_VERSION)) + 1).alias("next_version"))


def decision_row(spark: SparkSession, history: DataFrame, current_value: float, candidate_value: float, metric: str = "f1") -> DataFrame:
    """The event of comparing a candidate with the live model; always appended."""
    live = live_version(history).first()["version"]
    following = next_version(history).first()["next_version"]
    promoted = candidate_value > current_value and not math.isnan(candidate_value)
    row = (None, "decision", metric, promoted, live, following if promoted else live, following if promoted else None,
           float(current_value), float(candidate_value), None if promoted else "not better than the live model; archived")
    return spark.createDataFrame([row], HISTORY_SCHEMA).withColumn("at", F.current_timestamp().cast("timestamp_ntz"))


def override_row(spark: SparkSession, history: DataFrame, to_version: int, reason: str, event: str = "rollback") -> DataFrame:
    """A manual rollback or re-promotion; the target must have been issued."""
    if event not in ("rollback", "manual_promotion"):
        raise ValueError(f"unknown event {event!r}")
    issued = history.where((F.col("new_version") == to_version)).limit(1).count()
    if to_version != FIRST_VERSION and not issued:
        raise ValueError(f"version {to_version} was never issued")
    row = (None, event, "f1", False, live_version(history).first()["version"], to_version, None, None, None, reason)
    return spark.createDataFrame([row], HISTORY_SCHEMA).withColumn("at", F.current_timestamp().cast("timestamp_ntz"))


def overrides(history: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """The events of manual moves ``asked`` for (``by``, at, event, to_version, reason), for many histories in one job.

    A move to a version that its history never issued gives no event, nor does one of another kind than
    rollback and manual_promotion. ``from_version`` is the version in service at the end of the history.
    """
    by = list(by)
    issued = history.where(F.col("new_version").isNotNull()).select(*by, F.col("new_version").alias("to_version")).union(
        history.select(*by, F.lit(FIRST_VERSION))).distinct()
    live = live_version(history, by).withColumnRenamed("version", "from_version")
    moves = asked.where(F.col("event").isin("rollback", "manual_promotion")).join(issued, [*by, "to_version"], "left_semi").join(live, by)
    return moves.select(*by, "at", "event", F.lit(False).alias("promoted"), "from_version", "to_version", F.lit(None).cast("int").alias("new_version"),
                        F.lit(None).cast("double").alias("candidate_value"), "reason")


def version_table(history: DataFrame, by: list[str] = ()) -> DataFrame:
    """Every version ever issued with its metric, promotion time and status."""
    by = list(by)
    issued = history.where(F.col("new_version").isNotNull()).groupBy(*by, F.col("new_version").alias("version")).agg(
        F.max("at").alias("promoted_at"), F.max_by("candidate_value", "at").alias("metric_value"))
    first = history.select(*by).distinct().withColumn("version", F.lit(FIRST_VERSION)) if by else \
        history.sparkSession.range(1).select(F.lit(FIRST_VERSION).alias("version"))
    rows = issued.unionByName(first.join(issued, [*by, "version"], "left_anti"), allowMissingColumns=True)
    rolled = history.where(F.col("event") == "rollback").select(*by, F.col("from_version").alias("version")).distinct().withColumn(
        "_rolled", F.lit(True))
    live = live_version(history, by).withColumnRenamed("version", "_live")
    joined = rows.join(rolled, [*by, "version"], "left")
    joined = joined.join(live, by) if by else joined.withColumn("_live", live.scalar())
    status = F.when(F.col("version") == F.col("_live"), "active").when(
        F.col("_rolled") & (F.col("version") > F.col("_live")), "rolled_back").otherwise("retired")
    return joined.select(*by, "version", "metric_value", "promoted_at", status.alias("status"))


def health(model_exists: Column, f1: Column) -> Column:
    """unavailable, unverified, degraded (F1 below 0.40) or healthy."""
    return F.when(~model_exists, "unavailable").when(f1.isNull(), "unverified").when(f1 < HEALTHY_F1, "degraded").otherwise("healthy")


def is_stale(policy_version: Column, live: Column) -> Column:
    """Whether a policy was tuned on a model that is no longer live."""
    return policy_version.isNotNull() & (policy_version != live)
