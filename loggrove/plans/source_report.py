"""The whole chain of one source as one long report: (section, subject, measure, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loggrove.operators import baselines, forest as forests, metrics, sampling, search
from loggrove.operators.blocks import block_features
from loggrove.operators.clean import clean, ingest_stats, known, recognized
from loggrove.operators.labels import attach_labels
from loggrove.operators.prefix import prefix_features
from loggrove.operators.retention import Normalizer, block_table, evaluate_policy
from loggrove.operators.vocab import append_codes
from loggrove.plans import training
from loggrove.plans.early_warning import train_early_warning
from loggrove.schema import ANOMALY, ENCODED_COLUMNS, PREFIX_LENGTHS, TRAINING_FEATURES
from loggrove.scratch import written
from loggrove.sources.registry import get_source

KEPT = ("storage_saved_pct", "weighted_retention", "full_retention", "coverage", "fitness")


def _long(frame: DataFrame, section: str, subject, measures) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
    name = F.lit(subject) if isinstance(subject, str) else subject
    return frame.select(F.lit(section).alias("section"), name.alias("subject"), pairs.alias("_p")).select("section", "subject", "_p.*")


def source_report(structured: DataFrame, source: str, labels: DataFrame, population: int = 16, generations: int = 12, parents: int = 8,
                  policy_population: int = 60, policy_generations: int = 60, policy_parents: int = 20, trials: int = 10, counted_types: int = 1000, shared_types: int = 64) -> DataFrame:
    """Ingest, label, split, train, search, promote, tune retention and early warning.

    ``labels`` has block_id and label; blocks it lacks count as Normal. The early-warning models get a
    count column for each of the first ``counted_types`` event types by code, that is by first arrival; all
    later ones are counted in ``shared_types`` columns by their hash. A column that is constant in training
    is no input, so the shared ones cost nothing where there are no later types.
    """
    spec = get_source(source)
    structured = written(structured, "structured")
    cleaned = written(clean(recognized(structured), spec.dedupe), "cleaned")
    vocab = written(append_codes(cleaned.select(*[known(F.col(c)).alias(c) for c in ENCODED_COLUMNS])), "vocab")
    features = block_features(cleaned, vocab)
    labeled = written(attach_labels(features, labels), "labeled")
    stats = ingest_stats(structured, spec.dedupe)
    counts = labeled.agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("label") == ANOMALY).alias("anomalies"),
                         F.count_if("label_missing").alias("blocks_without_a_label"))
    if counts.first()["anomalies"] < 2:
        raise ValueError(f"{source}: fewer than two anomalous blocks; nothing to evaluate")
    parts = [_long(stats, "ingest", source, stats.columns), _long(counts, "labels", source, counts.columns)]
    signal = metrics.separability(labeled, list(TRAINING_FEATURES), F.col("label") == ANOMALY)
    parts.append(_long(signal, "feature_separability", F.col("feature"), ["separability"]))

    trained = training.train_source(labeled, spec.protocol, vocab, population, generations, parents)
    for name in ("baseline", "candidate"):
        parts.append(_long(trained[name].metrics(), "model", name, ("precision", "recall", "f1", "accuracy", "tp", "fp", "fn", "tn")))

    halves = written(sampling.stratified_split(labeled, 0.5, protocol=spec.protocol), "halves")
    refitted = forests.refit(trained["deployed"].forest, sampling.side(halves, "train"))
    scored = written(forests.predict(halves, refitted).withColumn("true_label", F.col("label")), "scored")
    table = written(block_table(scored, Normalizer.fit(sampling.side(scored, "train")), ("split",)), "table")
    tune, holdout = sampling.side(table, "train"), sampling.side(table, "test")
    policy, _ = search.search_policy(tune, policy_population, policy_generations, policy_parents)
    outcome = evaluate_policy(holdout, policy)
    parts.append(_long(outcome, "retention", "searched_policy", KEPT))
    compared = baselines.compare(tune, holdout, outcome, trials)
    parts.append(_long(compared, "retention", F.col("baseline"), KEPT))

    event_types = [r["value"] for r in vocab.where(F.col("column") == "event_type").orderBy("code").limit(counted_types).collect()]
    early = train_early_warning(prefix_features(cleaned, PREFIX_LENGTHS, vocab), labels, event_types, vocab=vocab, protocol=spec.protocol, shared=shared_types)
    for section, running in (("early_warning", False), ("early_warning_running", True)):
        parts.append(_long(early.report("test", running), section, F.concat(F.lit("k="), F.col("k")),
                           ("precision", "recall", "f1", "false_alarm_rate", "mean_lead", "expected_lead_per_alert")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
