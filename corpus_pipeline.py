"""A training corpus from ``documents``: five stages, each written and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``documents``; the last adds the number of each copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loggrove.llm import decontam, exact, mixing, near, toxicity
from loggrove.llm.registry import table
from loggrove.llm.shelf import Shelf


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on ``labels``, does not reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal apart from blanks."""
    return exact.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component under similarity 0.8 of five-word shingles."""
    return near.without_near_copies(docs, size=5)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ``benchmark`` item."""
    return decontam.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # trained scores and similarity links are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in turn; a stage's table goes when the next one's is written."""
    docs, shelf, last = table(spark, sf_dir, "documents"), Shelf(spark), None
    for name, stage in STAGES:
        docs = shelf.put(stage(spark, docs, sf_dir), name)
        if last is not None:
            shelf.drop(last)
        last = name
    return docs
