"""Training jobs: baseline and searched models, hold-out comparison, refit, retrain."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from loggrove.operators import forest as forests, labels as label_ops, metrics, sampling, search
from loggrove.operators.forest import Forest, ForestParams
from loggrove.plans import lineage
from loggrove.schema import SEED, TRAINING_FEATURES
from loggrove.scratch import written

TEST_SIZE = 0.3
FITNESS_ROWS = 40_000


@dataclass
class Trained:
    forest: Forest
    predictions: DataFrame   # test rows with label, predicted_label, anomaly_score

    def metrics(self) -> DataFrame:
        return metrics.evaluate(self.predictions, (), "label")


def train_and_test(split: DataFrame, params: ForestParams, vocab: DataFrame | None = None) -> Trained:
    """Fit on the training side, predict the test side."""
    model = forests.train(sampling.side(split, "train"), params, vocab=vocab)
    return Trained(model, forests.predict(sampling.side(split, "test"), model))


def gap_report(split: DataFrame, params: ForestParams) -> DataFrame:
    """Train against test metrics of one fit."""
    model = forests.train(sampling.side(split, "train"), params)
    scored = forests.predict(split, model)
    return metrics.evaluate(scored, ["split"], "label")


def compare_versions(blocks: DataFrame, versions: dict[str, ForestParams], seeds: list[int], test_size: float = TEST_SIZE) -> DataFrame:
    """F1 of every version refitted on every split, all fits in one grouped job.

    (version, seed, train_f1, test_f1, wins): wins marks the best test F1 of a seed.
    """
    rows, params = None, {}
    for seed in seeds:
        split = sampling.stratified_split(blocks, test_size, seed)
        for name, setting in versions.items():
            model = f"{name}/{seed}"
            params[model] = setting
            part = split.withColumn("version", F.lit(name)).withColumn("seed", F.lit(seed)).withColumn("model", F.lit(model))
            rows = part if rows is None else rows.unionByName(part)
    rows = written(rows, "versions")
    forest = forests.train(rows.where(F.col("split") == "train"), params, "model")
    counts = metrics.evaluate(forests.predict(rows, forest, "model"), ["version", "seed", "split"], "label")
    f1 = counts.groupBy("version", "seed").agg(
        F.max(F.when(F.col("split") == "train", F.col("f1"))).alias("train_f1"),
        F.max(F.when(F.col("split") == "test", F.col("f1"))).alias("test_f1"))
    best = f1.groupBy("seed").agg(F.max_by("version", F.struct("test_f1", "version")).alias("_best"))
    return f1.join(best, "seed").withColumn("wins", F.col("version") == F.col("_best")).drop("_best")


def version_summary(per_seed: DataFrame) -> DataFrame:
    return per_seed.groupBy("version").agg(
        F.avg("test_f1").alias("test_f1_mean"), F.stddev_pop("test_f1").alias("test_f1_std"),
        F.count_if("wins").alias("wins"), F.count(F.lit(1)).alias("seeds"))


def train_source(labeled: DataFrame, protocol: str = "holdout", vocab: DataFrame | None = None, population: int = 16,
                 generations: int = 12, parents: int = 8, fitness_rows: int = FITNESS_ROWS, features=TRAINING_FEATURES,
                 seed: int = SEED) -> dict:
    """The baseline, the searched candidate and the promotion decision between them."""
    split = written(sampling.stratified_split(labeled, TEST_SIZE, protocol=protocol), "split")
    train = sampling.side(split, "train")
    baseline = train_and_test(split, ForestParams(features=tuple(features)), vocab)
    fitness = written(sampling.stratified_sample(train, fitness_rows, seed), "fitness")
    best, found = search.search_forest(fitness, population, generations, parents, features=features, seed=seed)
    candidate = train_and_test(split, best, vocab)
    before, after = baseline.metrics().first(), candidate.metrics().first()
    decision = lineage.decide(1, before["f1"], after["f1"], issued=[1])
    return {"split": split, "baseline": baseline, "candidate": candidate, "best": best, "search": found,
            "baseline_metrics": before, "candidate_metrics": after, "decision": decision,
            "deployed": candidate if decision["promoted"] else baseline}


def retrain(spark: SparkSession, labeled: DataFrame, feedback: DataFrame | None, incumbent: Forest, incumbent_f1: float,
            history: DataFrame, protocol: str = "holdout", seed: int = SEED, population: int = 16, generations: int = 12,
            parents: int = 8, fitness_rows: int = FITNESS_ROWS, features=TRAINING_FEATURES) -> dict:
    """One adaptation cycle: verdicts override labels, search, fit, score, promote if
    strictly better. The incumbent is scored again when verdicts changed the labels."""
    applied = 0
    if feedback is not None:
        verdicts = label_ops.latest_verdicts(feedback)
        counts = label_ops.feedback_counts(labeled, verdicts).first()
        applied = counts["applied"]
        labeled = label_ops.apply_feedback(labeled, verdicts).drop("verdict", "previous_label")
    split = written(sampling.stratified_split(labeled, TEST_SIZE, protocol=protocol), "split")
    train, test = sampling.side(split, "train"), sampling.side(split, "test")
    fitness = written(sampling.stratified_sample(train, fitness_rows, seed), "fitness")
    best, found = search.search_forest(fitness, population, generations, parents, features=features, seed=seed)
    candidate = train_and_test(split, replace(best, seed=seed), incumbent.vocab)
    candidate_f1 = candidate.metrics().first()["f1"]
    if applied:
        incumbent_f1 = metrics.evaluate(forests.predict(test, incumbent), (), "label").first()["f1"]
    event = lineage.decision_row(spark, history, incumbent_f1, candidate_f1)
    return {"candidate": candidate, "search": found, "applied": applied, "incumbent_f1": incumbent_f1,
            "candidate_f1": candidate_f1, "event": event, "history": history.unionByName(event, allowMissingColumns=True)}
