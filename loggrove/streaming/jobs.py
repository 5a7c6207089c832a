"""The stream job: score snapshots and finished blocks, write alerts and decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQueryListener

from loggrove.functions.stats import ratio
from loggrove.operators import forest as forests
from loggrove.operators.forest import Forest
from loggrove.operators.prefix import count_columns
from loggrove.operators.retention import Normalizer, Policy, block_table, decide
from loggrove.schema import ANOMALY, ENCODED_COLUMNS
from loggrove.streaming.blocks import OUTPUT_SCHEMA, block_stream, open_blocks

TABLES = ("alerts", "decisions", "counts")
COUNTS = ("accepted", "duplicates", "late", "rejected", *[f"unseen_{c}" for c in ENCODED_COLUMNS])


@dataclass
class Scorer:
    """Everything a stream is scored with; fitted by batch jobs."""

    deployed: Forest
    early: Forest                  # one model per prefix length
    thresholds: dict[int, float]
    event_types: list[str]
    storage: Forest                # the model the policy was tuned on
    policy: Policy
    normalizer: Normalizer


def _moment(column: str):
    return F.timestamp_seconds(column).cast("timestamp_ntz")


def _fired(snapshots: DataFrame, scorer: Scorer) -> DataFrame:
    """Snapshots at or above the threshold of their k."""
    scored = forests.score(count_columns(snapshots, scorer.event_types), scorer.early, "k")
    threshold = F.lit(None).cast("double")
    for k, value in scorer.thresholds.items():
        threshold = F.when(F.col("k") == k, F.lit(value)).otherwise(threshold)
    return scored.withColumn("threshold", threshold).where(F.col("score") >= F.col("threshold"))


def early_alerts(rows: DataFrame, scorer: Scorer, run_id: str) -> DataFrame:
    """Per block the first k that fires, if that is a snapshot of these rows.

    A snapshot brings the block's earlier ones along (at most one per prefix length), which are scored
    again: what one of them fired in an earlier batch is told already. So nothing of the run is read.
    """
    snapshots = rows.where(F.col("kind") == "snapshot")
    fields = T.StructType([f for f in OUTPUT_SCHEMA if f.name not in ("kind", "block_id", "earlier")])
    before = snapshots.select("block_id", F.explode("earlier").alias("_e")).select(
        F.lit("snapshot").alias("kind"), "block_id", F.from_json("_e", fields).alias("_p")).select("kind", "block_id", "_p.*")
    # The same snapshot may come along with several later ones, and be in these rows itself.
    both = snapshots.drop("earlier").withColumn("_here", F.lit(True)).unionByName(before.withColumn("_here", F.lit(False)))
    first = _fired(both, scorer).groupBy("block_id").agg(F.min_by(F.struct("k", "score", "threshold", "event_seconds"), "k").alias("_a"),
                                                         F.min(F.when(F.col("_here"), F.col("k"))).alias("_k_here"))
    return first.where(F.col("_k_here") == F.col("_a.k")).select("block_id", "_a.*").select(
        F.concat_ws(":", F.lit(run_id), F.lit("early_warning"), "block_id").alias("alert_id"), F.lit(run_id).alias("run_id"),
        F.lit("early_warning").alias("type"), "block_id", "score", "threshold", F.col("k").cast("long").alias("events_seen"),
        _moment("event_seconds").alias("event_time"), "k", F.lit(None).cast("string").alias("finalize_reason"))


def decisions(rows: DataFrame, scorer: Scorer, run_id: str) -> DataFrame:
    """Verdict, importance, tier and kept lines of every finished block."""
    finals = rows.where(F.col("kind") == "final")
    # Both models score the same rows: one pass, no join.
    judged = forests.predict(finals, scorer.deployed).withColumnsRenamed({"anomaly_score": "verdict_score", "predicted_label": "verdict"})
    base = forests.predict(judged, scorer.storage).drop("predicted_label").withColumnsRenamed({"verdict": "predicted_label"}).withColumn(
        "true_label", F.lit(None).cast("string"))
    table = block_table(base, scorer.normalizer, ("predicted_label", "verdict_score", "reason", "event_frequency",
                                                  "first_seconds", "last_seconds", "event_seconds"))
    return decide(table, scorer.policy).select(
        F.lit(run_id).alias("run_id"), "block_id", "reason", F.col("event_frequency").alias("events"),
        _moment("first_seconds").alias("first_event_time"), _moment("last_seconds").alias("last_event_time"),
        _moment("event_seconds").alias("last_arrival_time"),
        "predicted_label", F.col("verdict_score").alias("anomaly_score"), "importance", "tier", F.col("kept").alias("lines_kept"))


def block_alerts(decided: DataFrame, run_id: str) -> DataFrame:
    flagged = decided.where(F.col("predicted_label") == ANOMALY)
    return flagged.select(
        F.concat_ws(":", F.lit(run_id), F.lit("block_anomaly"), "block_id").alias("alert_id"), F.lit(run_id).alias("run_id"),
        F.lit("block_anomaly").alias("type"), "block_id", F.col("anomaly_score").alias("score"), F.lit(None).cast("double").alias("threshold"),
        F.col("events").alias("events_seen"), F.col("last_arrival_time").alias("event_time"), F.lit(None).cast("int").alias("k"),
        F.col("reason").alias("finalize_reason"))


def _folder(out: str, name: str, run_id: str) -> str:
    return f"{out}/{name}/run={run_id}"


def earlier_alerts(spark: SparkSession, out: str, run_id: str, epoch: int) -> DataFrame:
    """Ids that the run's earlier batches have written; only for snapshots that do not know their earlier ones."""
    try:
        written = spark.read.parquet(_folder(out, "alerts", run_id))
    except AnalysisException:  # nothing has been written yet
        return spark.createDataFrame([], "alert_id string")
    return written.where(F.col("epoch") < epoch).select("alert_id")


def write_outputs(rows: DataFrame, scorer: Scorer, run_id: str, out: str, epoch: int) -> None:
    """Write one batch's alerts, decisions and counts. Every batch of every run owns its folder,
    so a repeated batch replaces what it wrote before and runs never touch each other's rows.
    A block's early warning is written once. The counts come last and commit the batch:
    ``read_outputs`` leaves out alerts and decisions of a batch whose counts are not there."""
    spark = rows.sparkSession
    rows = rows.persist()
    try:
        decided = decisions(rows, scorer, run_id).persist()
        early = early_alerts(rows, scorer, run_id)
        if not rows.where((F.col("kind") == "snapshot") & F.col("earlier").isNull()).isEmpty():
            early = early.join(earlier_alerts(spark, out, run_id, epoch), "alert_id", "left_anti")
        alerts = early.unionByName(block_alerts(decided, run_id))
        counted = rows.where(F.col("kind") == "counts").agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS], F.current_timestamp().alias("at")).withColumn(
            "run_id", F.lit(run_id))
        for name, frame in (("alerts", alerts), ("decisions", decided), ("counts", counted)):
            frame.write.mode("overwrite").parquet(f"{_folder(out, name, run_id)}/epoch={epoch}")
        decided.unpersist()
    finally:
        rows.unpersist()


FLUSH_EPOCH = 1_000_000_000


def run_stream(events: DataFrame, source: str, scorer: Scorer, run_id: str, out: str, checkpoint: str, ks=None, **options):
    """Start the job on a stream of coded events with the available-now trigger."""
    rows = block_stream(events, source, ks or sorted(scorer.thresholds), **options)
    return rows.writeStream.foreachBatch(lambda batch, epoch: write_outputs(batch, scorer, run_id, out, epoch)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush(spark: SparkSession, scorer: Scorer, run_id: str, out: str, checkpoint: str) -> None:
    """Finish every block still in flight after the stream ended."""
    write_outputs(open_blocks(spark, checkpoint), scorer, run_id, out, FLUSH_EPOCH)


def read_outputs(spark: SparkSession, out: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """The written tables of one run or of all, committed batches only (one row each says so)."""
    tables = {name: spark.read.parquet(f"{out}/{name}") for name in TABLES}
    committed = tables["counts"].select("run", "epoch").distinct()
    tables = {name: (frame if name == "counts" else frame.join(committed, ["run", "epoch"], "left_semi")).drop("epoch", "run")
              for name, frame in tables.items()}
    return {name: frame.where(F.col("run_id") == run_id) if run_id else frame for name, frame in tables.items()}


def with_leads(decided: DataFrame, alerts: DataFrame) -> DataFrame:
    """Decisions with the k of their early warning and the share of the block after it."""
    early = alerts.where(F.col("type") == "early_warning").select("run_id", "block_id", F.col("k").alias("early_warning_k"))
    return decided.join(early, ["run_id", "block_id"], "left").withColumn(
        "early_warning_lead", (F.col("events") - F.col("early_warning_k")) / F.col("events"))


def alerts_with_leads(alerts: DataFrame, decided: DataFrame) -> DataFrame:
    """Early alerts with the lead known once their block has ended."""
    ends = decided.select("run_id", "block_id", F.col("events").alias("events_total"), F.col("reason").alias("block_finalized"))
    return alerts.where(F.col("type") == "early_warning").join(ends, ["run_id", "block_id"], "left").withColumn(
        "lead_fraction", (F.col("events_total") - F.col("k")) / F.col("events_total"))


def run_status(alerts: DataFrame, decided: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row per run: alerts by type, blocks by tier and reason, lines and saving."""
    by_type = alerts.groupBy("run_id").agg(*[
        F.coalesce(F.count_if(F.col("type") == t), F.lit(0)).alias(f"{t}_alerts") for t in ("early_warning", "block_anomaly")])
    tiers = decided.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("blocks_decided"), F.sum("events").alias("lines_seen"), F.sum("lines_kept").alias("lines_kept"),
        *[F.count_if(F.col("tier") == t).alias(f"{t.lower()}_blocks") for t in ("HOT", "WARM", "COLD")],
        *[F.count_if(F.col("reason") == r).alias(f"{r}_blocks") for r in ("timeout", "end_of_stream")])
    out = tiers.join(by_type, "run_id", "left").withColumns({
        "early_warning_alerts": F.coalesce("early_warning_alerts", F.lit(0)), "block_anomaly_alerts": F.coalesce("block_anomaly_alerts", F.lit(0)),
        "storage_saved_pct": 100.0 * (1 - ratio(F.col("lines_kept"), F.col("lines_seen"), 1.0))})
    if counts is not None:
        out = out.join(counts.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in COUNTS]), "run_id", "left")
    return out


def events_per_second(events: DataFrame, window_seconds: int = 5, slide_seconds: int = 1, time: str = "ts") -> DataFrame:
    """Events per second over sliding windows."""
    window = F.window(time, f"{window_seconds} seconds", f"{slide_seconds} seconds")
    return events.groupBy(window.alias("_w")).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("_w.start").cast("timestamp_ntz").alias("window_start"), "events", (F.col("events") / window_seconds).alias("events_per_second"))


def list_alerts(alerts: DataFrame, type_: str = "all", limit: int = 50, run_id: str | None = None) -> DataFrame:
    """The newest run's alerts (or one run's), newest first."""
    run = F.lit(run_id) if run_id else alerts.agg(F.max_by("run_id", F.struct("event_time", "run_id"))).scalar()
    out = alerts.where(F.col("run_id") == run)
    if type_ != "all":
        out = out.where(F.col("type") == type_)
    return out.orderBy(F.col("event_time").desc(), "alert_id").limit(limit)


def best_k(trade_off: DataFrame | None, default: int = 20) -> int:
    """The prefix length a report chose, or the default."""
    row = trade_off.where("is_best").select("k").first() if trade_off is not None else None
    return int(row["k"]) if row else default


class InputCounts(StreamingQueryListener):
    """What streams read: lines, unparsed lines and values the vocabulary lacked, from the engine's
    observed metrics of every batch. Register it with ``spark.streams.addListener`` before the
    start; a query's own progress list forgets all but its newest batches."""

    def __init__(self) -> None:
        self._batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found: dict[str, int] = {}
        for row in event.progress.observedMetrics.values():
            for name, value in row.asDict().items():
                found[name] = found.get(name, 0) + int(value or 0)
        # A batch that is run again replaces its counts; one without input reports none.
        if found:
            self._batches[str(event.progress.id), event.progress.batchId] = found

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self, query) -> dict[str, int]:
        """Sums over all batches of one query."""
        out: dict[str, int] = {}
        for (of, _), found in self._batches.items():
            if of == str(query.id):
                for name, value in found.items():
                    out[name] = out.get(name, 0) + value
        return out
