"""Early-warning models: one forest per prefix length, all grown in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loggrove.operators import forest as forests, metrics, sampling
from loggrove.operators.blocks import constant_columns
from loggrove.operators.forest import Forest, ForestParams
from loggrove.operators.prefix import count_columns, model_columns
from loggrove.schema import ANOMALY, SEED
from loggrove.scratch import written


@dataclass
class EarlyWarning:
    forest: Forest
    thresholds: dict[int, float]
    features: dict[int, list[str]]
    dropped: dict[int, list[str]]
    train: DataFrame     # scored prefix rows with alert, lead, …
    test: DataFrame

    def alerts(self, name: str = "test", running_only: bool = False) -> DataFrame:
        rows = self.train if name == "train" else self.test
        return rows.where(F.col("total_events") > F.col("k")) if running_only else rows

    def report(self, name: str = "test", running_only: bool = False) -> DataFrame:
        return metrics.alert_metrics(self.alerts(name, running_only), ["k"])

    def best_k(self, running_only: bool = True) -> DataFrame:
        points = self.report("test", running_only).select("k", "precision", "mean_lead", "expected_lead_per_alert")
        return metrics.pareto_front(points, "k", "precision", "mean_lead", "expected_lead_per_alert")


def judged(scored: DataFrame, thresholds: dict[int, float]) -> DataFrame:
    """Alerts fire at the threshold (not only beyond it)."""
    threshold = F.lit(None).cast("double")
    for k, value in thresholds.items():
        threshold = F.when(F.col("k") == k, F.lit(value)).otherwise(threshold)
    return scored.withColumns({
        "threshold": threshold, "is_anomaly": F.col("label") == ANOMALY,
        "lead": metrics.lead_fraction(F.col("total_events"), F.col("k")),
        "lead_seconds": F.greatest(F.col("block_end_seconds") - F.col("prefix_end_seconds"), F.lit(0)),
    }).withColumn("alert", F.col("score") >= F.col("threshold"))


def train_early_warning(prefixes: DataFrame, labels: DataFrame, event_types: list[str], test_size: float = 0.3,
                        base: ForestParams = ForestParams(), vocab: DataFrame | None = None, protocol: str = "holdout", shared: int = 0) -> EarlyWarning:
    """Fit, tune and evaluate all prefix lengths on one and the same split of blocks.

    Blocks without a label count as Normal. Labels never reach the fit. Event types that are not
    among ``event_types`` are inputs through ``shared`` columns (see ``count_columns``).
    """
    rows = count_columns(prefixes, event_types, shared).drop("type_counts")
    blocks = rows.select("block_id").distinct().join(labels.select("block_id", "label"), "block_id", "left").select(
        "block_id", F.coalesce("label", F.lit("Normal")).alias("label"))
    split = sampling.stratified_split(written(blocks, "labels"), test_size, SEED, protocol=protocol)
    rows = written(rows.join(split, "block_id"), "prefixes")
    train = sampling.side(rows, "train")
    inputs = model_columns(event_types, shared)
    dropped = constant_columns(train, inputs, by="k")
    ks = sorted(dropped)
    features = {k: [c for c in inputs if c not in dropped[k]] for k in ks}
    params = {str(k): ForestParams(trees=base.trees, rows_per_tree=base.rows_per_tree, feature_share=base.feature_share,
                                   bootstrap=base.bootstrap, features=tuple(features[k]), seed=base.seed) for k in ks}
    forest = forests.train(train, params, "k", vocab=vocab)
    scored = written(forests.score(rows, forest, "k"), "prefix_scores")
    tuned = metrics.tune_threshold(sampling.side(scored, "train"), "score", F.col("label") == ANOMALY, by=["k"])
    thresholds = {row["k"]: float(row["threshold"]) for row in tuned.collect()}  # one row per k
    done = judged(scored, thresholds)
    return EarlyWarning(forest, thresholds, features, dropped, sampling.side(done, "train"), sampling.side(done, "test"))
