"""Scoring a finished stream replay against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loggrove.functions.stats import count_if, ratio
from loggrove.operators.ordering import grouped_quantile
from loggrove.schema import ANOMALY, ARRIVAL_SEQ, NORMAL


def replay_coverage(log: DataFrame, replayed_lines: int) -> DataFrame:
    """Lines per block inside the replayed head of the log and in all of it."""
    inside = count_if(F.col(ARRIVAL_SEQ) < replayed_lines)
    return log.groupBy("block_id").agg(inside.alias("lines_in_replay"), F.count(F.lit(1)).alias("lines_in_file")).withColumn(
        "complete", F.col("lines_in_replay") >= F.col("lines_in_file"))


def judged_decisions(decisions: DataFrame, labels: DataFrame, early_alerts: DataFrame, coverage: DataFrame) -> DataFrame:
    """Decisions with their label, early alert and completeness (three left joins)."""
    early = early_alerts.select("block_id", F.col("event_time").alias("alert_time"), F.lit(True).alias("early_alert"))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return (
        decisions.join(labels.select("block_id", "label"), "block_id", "left")
        .join(early, "block_id", "left")
        .join(coverage.select("block_id", "lines_in_replay", "lines_in_file", "complete"), "block_id", "left")
        .withColumns({
            "unlabeled": F.col("label").isNull(),
            "is_anomaly": F.coalesce("label", F.lit(NORMAL)) == ANOMALY,
            "early_alert": F.coalesce("early_alert", F.lit(False)),
            "block_alert": F.col("predicted_label") == ANOMALY,
            "lead_seconds": seconds("last_event_time") - seconds("alert_time"),
        })
    )


def detection(frame: DataFrame, flagged: Column, by: list[str]) -> DataFrame:
    """Detection counts and rates per group; a rate without a denominator is null."""
    actual = F.col("is_anomaly")
    agg = frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("blocks"), count_if(actual).alias("anomalies"), count_if(flagged).alias("alerts"),
        count_if(flagged & actual).alias("true_alerts"), count_if(flagged & ~actual).alias("false_alerts"))
    c = F.col
    return agg.withColumns({
        "precision": ratio(c("true_alerts"), c("alerts"), None), "recall": ratio(c("true_alerts"), c("anomalies"), None),
        "false_alarm_rate": ratio(c("false_alerts"), c("blocks") - c("anomalies"), None),
        "anomaly_share": ratio(c("anomalies"), c("blocks"), None)})


def replay_report(judged: DataFrame, by: list[str], k: int) -> DataFrame:
    """Block alerts and early alerts per group, also on blocks that reached k events,
    in one long table keyed by ``measure``."""
    reached = judged.where(F.col("events") >= k)
    parts = [("block_anomaly", judged, F.col("block_alert")), ("early_warning", judged, F.col("early_alert")),
             ("early_warning_reaching_k", reached, F.col("early_alert"))]
    out = None
    for name, frame, flagged in parts:
        one = detection(frame, flagged, by).withColumn("measure", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def lead_report(judged: DataFrame, by: list[str]) -> DataFrame:
    """Lead of true early alerts per group: count, mean and exact median, in events and seconds."""
    hits = judged.where(F.col("early_alert") & F.col("is_anomaly"))
    out = hits.groupBy(*by).agg(
        F.count("early_warning_lead").alias("n"), F.avg("early_warning_lead").alias("mean_lead"),
        F.avg("lead_seconds").alias("mean_lead_seconds"), count_if(F.col("early_warning_lead") > 0).alias("before_block_end"))
    for column, name in (("early_warning_lead", "median_lead"), ("lead_seconds", "median_lead_seconds")):
        out = out.join(grouped_quantile(hits, column, 0.5, tuple(by), name), by, "left")
    return out
