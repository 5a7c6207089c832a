"""Scoring new files with a deployed model, and blind checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loggrove.functions.stats import count_if, ratio
from loggrove.operators import forest as forests, metrics
from loggrove.operators.blocks import block_features, block_metadata
from loggrove.operators.clean import clean, known, recognized
from loggrove.operators.forest import Forest
from loggrove.operators.vocab import append_codes, fingerprint, require_compatible
from loggrove.schema import ANOMALY, ENCODED_COLUMNS
from loggrove.scratch import written
from loggrove.sources.registry import get_source


def score_upload(structured: DataFrame, source: str, forest: Forest, vocab: DataFrame | None, version: int | None = None) -> DataFrame:
    """Predictions and a description of every block of a parsed file.

    Refuses without the source's vocabulary, or when codes were renumbered since the
    model was trained; values the vocabulary lacks are appended, which moves no code.
    The model's and the vocabulary's fingerprints are on every row.
    """
    if vocab is None:
        raise ValueError("the source has no vocabulary; build its features first")
    require_compatible(forest.vocab, vocab)
    cleaned = written(clean(recognized(structured), get_source(source).dedupe), "upload")
    grown = written(append_codes(cleaned.select(*[known(F.col(c)).alias(c) for c in ENCODED_COLUMNS]), vocab), "vocab")
    predicted = forests.predict(block_features(cleaned, grown), forest).select("block_id", "predicted_label", "anomaly_score")
    return block_metadata(cleaned).join(predicted, "block_id").withColumns({
        "model_version": F.lit(version), "model_vocabulary": fingerprint(forest.vocab).scalar(),
        "vocabulary": fingerprint(vocab).scalar()})


def result_counts(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Blocks, anomalies and the anomaly rate in percent, two decimals."""
    agg = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("blocks_analyzed"), count_if(F.col("predicted_label") == ANOMALY).alias("anomalies_detected"))
    return agg.withColumn("anomaly_rate_pct", F.round(100.0 * ratio(F.col("anomalies_detected"), F.col("blocks_analyzed")), 2))


def merge_uploads(dataset: DataFrame, uploads: DataFrame) -> DataFrame:
    """The dataset's blocks plus uploaded blocks it lacks, one row per block.

    Among uploads the first delivery of a block counts. Uploaded blocks are unlabeled.
    """
    columns = [c for c in uploads.columns if c not in ("upload_id", "uploaded_at", "block_id")]
    first = uploads.groupBy("block_id").agg(F.min(F.struct("uploaded_at", "upload_id", *columns)).alias("_u"))
    fresh = first.select("block_id", *[f"_u.{c}" for c in columns]).join(dataset.select("block_id"), "block_id", "left_anti")
    return dataset.withColumn("origin", F.lit("dataset")).unionByName(
        fresh.withColumn("origin", F.lit("upload")), allowMissingColumns=True)


def verify_blind(predictions: DataFrame, answers: DataFrame) -> DataFrame:
    """Metrics of predictions made without labels against an answer key joined afterwards."""
    if "label" in predictions.columns or "true_label" in predictions.columns:
        raise ValueError("predictions for a blind check must not carry labels")
    joined = predictions.join(answers.select("block_id", F.col("label").alias("true_label")), "block_id")
    return metrics.evaluate(joined)
