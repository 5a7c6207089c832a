"""Reports over predictions, metadata, uploads and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loggrove.functions.stats import count_if, ratio
from loggrove.operators.metrics import with_severity
from loggrove.plans.uploads import merge_uploads
from loggrove.schema import ANOMALY, NORMAL
from loggrove.scratch import written

# --- fixed values ----------------------------------------------------------
TOP_COMPONENTS = 9
TOP_EVENT_TYPES = 10
SEARCHED = ("block_id", "component", "event_type", "source_ip")
EXPORTED = ("block_id", "first_seen", "component", "event_type", "source_ip", "destination_ip",
            "anomaly_score", "severity", "predicted_label", "true_label", "origin")


def current_predictions(predictions: DataFrame, metadata: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """Scores with block descriptions, uploaded blocks and severity. Severity is cut
    after the union, so an uploaded anomaly is ranked on the same scale."""
    joined = predictions.join(metadata, "block_id", "left")
    merged = merge_uploads(joined, uploads) if uploads is not None else joined.withColumn("origin", F.lit("dataset"))
    return with_severity(written(merged, "predictions"))


def filter_detections(view: DataFrame, severity: str = "all", search: str = "") -> DataFrame:
    """Rows of one severity whose id, component, event type or address contains a text
    (case does not matter, no pattern characters)."""
    severity, search = severity.strip().lower(), search.strip().lower()
    out = view if severity == "all" else view.where(F.col("severity") == severity)
    if search:
        hit = F.lit(False)
        for column in SEARCHED:
            hit = hit | F.coalesce(F.contains(F.lower(column), F.lit(search)), F.lit(False))
        out = out.where(hit)
    return out


def detections_page(view: DataFrame, page: int = 1, limit: int = 25, severity: str = "all", search: str = "") -> DataFrame:
    """One page by falling score; ties by block id. Only the top page * limit rows are kept while sorting."""
    page, limit = max(1, page), min(200, max(1, limit))
    rows = filter_detections(view, severity, search).orderBy(F.col("anomaly_score").desc(), "block_id")
    return rows.offset((page - 1) * limit).limit(limit)


def export_detections(view: DataFrame, path: str, severity: str = "all", search: str = "") -> None:
    """All matching rows as CSV, in order of falling score."""
    columns = [c for c in EXPORTED if c in view.columns]
    filter_detections(view, severity, search).orderBy(F.col("anomaly_score").desc(), "block_id").select(*columns).write.option(
        "header", True).csv(path)


def detections_summary(view: DataFrame) -> DataFrame:
    flagged = F.col("predicted_label") == ANOMALY
    return view.agg(F.count(F.lit(1)).alias("total_analyzed"), count_if(~flagged).alias("normal_count"),
                    count_if(flagged).alias("anomalous_count"), F.avg("anomaly_score").alias("avg_anomaly_score"))


def severity_mix(view: DataFrame) -> DataFrame:
    return view.where(F.col("predicted_label") == ANOMALY).groupBy("severity").agg(F.count(F.lit(1)).alias("blocks"))


def recent_anomalies(view: DataFrame, n: int = 5) -> DataFrame:
    return view.where(F.col("predicted_label") == ANOMALY).orderBy(F.col("anomaly_score").desc(), "block_id").limit(n)


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def volume_by_day(log: DataFrame, view: DataFrame) -> DataFrame:
    """Lines, blocks and anomalies per day. Lines and blocks are counted separately; an
    uploaded block's lines land on the day it was first seen."""
    lines = log.groupBy(_day("datetime").alias("day")).agg(F.count(F.lit(1)).alias("lines"))
    uploaded = F.when(F.col("origin") == "upload", F.col("event_frequency"))
    blocks = view.groupBy(_day("first_seen").alias("day")).agg(
        F.count(F.lit(1)).alias("blocks"), count_if(F.col("predicted_label") == ANOMALY).alias("anomalies"),
        F.coalesce(F.sum(uploaded), F.lit(0)).alias("_uploaded"))
    return lines.join(blocks, "day", "full").select(
        "day", (F.coalesce("lines", F.lit(0)) + F.coalesce("_uploaded", F.lit(0))).alias("lines"),
        F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("anomalies", F.lit(0)).alias("anomalies"))


def kpis(log: DataFrame, view: DataFrame, metrics: DataFrame) -> DataFrame:
    """Totals, anomaly rate, what uploads added, and the model's false-positive rate."""
    flagged, uploaded = F.col("predicted_label") == ANOMALY, F.col("origin") == "upload"
    totals = view.agg(
        F.count(F.lit(1)).alias("total_blocks_analyzed"), count_if(flagged).alias("anomalies_detected"),
        count_if(uploaded).alias("uploaded_blocks_added"),
        F.coalesce(F.sum(F.when(uploaded, F.col("event_frequency"))), F.lit(0)).alias("uploaded_lines_added"))
    out = totals.withColumn("_lines", log.agg(F.count(F.lit(1))).scalar()).withColumn(
        "_fpr", metrics.select("false_positive_rate").scalar())
    return out.select(
        (F.col("_lines") + F.col("uploaded_lines_added")).alias("total_lines_processed"), "total_blocks_analyzed", "anomalies_detected",
        (100.0 * ratio(F.col("anomalies_detected"), F.col("total_blocks_analyzed"))).alias("anomaly_rate_pct"),
        (100.0 * F.col("_fpr")).alias("false_positive_rate_pct"), "uploaded_blocks_added", "uploaded_lines_added")


def hours_of_day(features: DataFrame) -> DataFrame:
    return features.groupBy("hour_of_day").agg(F.count(F.lit(1)).alias("blocks"))


def anomalies_by_day(view: DataFrame) -> DataFrame:
    days = view.groupBy(_day("first_seen").alias("day")).pivot("predicted_label", [ANOMALY, NORMAL]).agg(F.count(F.lit(1)))
    return days.select("day", F.coalesce(ANOMALY, F.lit(0)).alias("anomalies"), F.coalesce(NORMAL, F.lit(0)).alias("normal"))


def top_values(log: DataFrame, column: str, n: int) -> DataFrame:
    return log.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(n)


def anomalies_by_component_and_day(log: DataFrame, view: DataFrame, n: int = TOP_COMPONENTS) -> DataFrame:
    """(day, component, anomalies) for the components with most lines."""
    top = top_values(log, "component", n).select(F.col("name").alias("component"))  # n rows
    return view.where(F.col("predicted_label") == ANOMALY).join(F.broadcast(top), "component", "left_semi").groupBy(
        _day("first_seen").alias("day"), "component").agg(F.count(F.lit(1)).alias("anomalies"))


def policy_comparison(outcomes: dict[str, DataFrame], measures=("storage_saved_pct", "weighted_retention", "full_retention", "coverage", "fitness")) -> DataFrame:
    """Policies scored by several models side by side: (variant, measure, value)."""
    out = None
    for variant, outcome in outcomes.items():
        pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
        one = outcome.select(F.lit(variant).alias("variant"), pairs.alias("_p")).select("variant", "_p.*")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("measure").pivot("variant", list(outcomes)).agg(F.first("value"))


def list_feedback(verdicts: DataFrame, source: str, limit: int = 500) -> DataFrame:
    """One source's latest verdicts, newest first."""
    return verdicts.where(F.col("source") == source).orderBy(F.col("at").desc(), "block_id").limit(limit)
