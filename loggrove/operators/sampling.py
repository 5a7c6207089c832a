"""Seeded, exact splits and samples that do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from loggrove.operators.ordering import ranked, seeded_hash
from loggrove.schema import SEED

DIGITS = 3  # of the hash of a row, in hexadecimal, by which rows are counted
LABEL_LIKE = ("label", "true_label", "predicted_label", "is_anomaly")


def _class_ranks(blocks: DataFrame, seed, label: str, key: str) -> DataFrame:
    """Random rank of every row inside its class."""
    hashed = blocks.withColumn("_hash", seeded_hash(seed, key))
    return ranked(hashed, ["_hash", key], within=(label,), position="_rank").drop("_hash")


def _class_sizes(blocks: DataFrame, label: str) -> list[tuple]:
    return sorted((row[label], row["count"]) for row in blocks.groupBy(label).count().collect())


def _first_of_class(blocks: DataFrame, seed, label: str, key: str, take) -> Column | None:
    """Whether a row is among the first ``take(size)`` of its class in random order, without ordering the rows.

    Rows are counted by class and the first digits of their hash. The last row taken is sought only among those that
    share its first digits; a row is among the first if it does not come after that one. None if rows of equal hash
    and key straddle the end, which only ranks can tell apart.
    """
    hashed = blocks.select(F.col(label).alias("_class"), seeded_hash(seed, key).alias("_hash"), F.col(key).alias("_key")).where(
        F.col("_class").isNotNull())
    digits = F.substring("_hash", 1, DIGITS)
    # At most 16 ** DIGITS rows per class.
    counts = hashed.groupBy("_class", digits.alias("_digits")).count().orderBy("_class", "_digits").collect()
    sizes: dict = {}
    for row in counts:
        sizes[row["_class"]] = sizes.get(row["_class"], 0) + row["count"]
    wanted, before = {c: take(n) for c, n in sizes.items()}, dict.fromkeys(sizes, 0)
    ends = []
    for row in counts:
        left = wanted[row["_class"]] - before[row["_class"]]
        if 0 < left <= row["count"]:
            ends.append((row["_class"], row["_digits"], left))
        before[row["_class"]] += row["count"]
    if not ends:
        return F.lit(False)
    kind = hashed.schema["_class"].dataType.simpleString()
    asked = blocks.sparkSession.createDataFrame(ends, f"_class {kind}, _digits string, _left long")
    near = hashed.withColumn("_digits", digits).join(F.broadcast(asked), ["_class", "_digits"])
    order = Window.partitionBy("_class").orderBy("_hash", "_key")
    placed = near.withColumn("_rank", F.row_number().over(order)).withColumn("_same", F.lead(F.struct("_hash", "_key")).over(order))
    last = placed.where(F.col("_rank") == F.col("_left")).withColumn("_straddles", F.col("_same").eqNullSafe(F.struct("_hash", "_key"))).collect()
    if any(row["_straddles"] or row["_key"] is None for row in last):
        return None
    hash_of, first = seeded_hash(seed, key), F.lit(False)
    for row in last:
        # Null keys come first.
        upto = (hash_of < row["_hash"]) | ((hash_of == row["_hash"]) & F.coalesce(F.col(key) <= F.lit(row["_key"]), F.lit(True)))
        first = F.when(F.col(label) == row["_class"], upto).otherwise(first)
    return first


def _taken(blocks: DataFrame, seed, label: str, key: str, take) -> tuple[DataFrame, Column]:
    """The rows, and whether each is among the first ``take(size)`` of its class; ``_rank`` is there if ranks were needed."""
    first = _first_of_class(blocks, seed, label, key, take)
    if first is not None:
        return blocks, first
    return _class_ranks(blocks, seed, label, key), F.col("_rank") <= _quota(_class_sizes(blocks, label), label, take)


def _quota(sizes: list[tuple], label: str, take) -> Column:
    """The number of rows wanted per class as one column expression."""
    chosen = F.lit(0)
    for value, size in sizes:
        chosen = F.when(F.col(label) == value, F.lit(take(size))).otherwise(chosen)
    return chosen


def stratified_split(blocks: DataFrame, test_size: float, seed=SEED, label: str = "label", key: str = "block_id",
                     protocol: str = "holdout") -> DataFrame:
    """Add ``split``: 'train' or 'test' with the exact share per class. Under the
    in-sample protocol every row belongs to both sides ('all')."""
    if protocol == "in_sample":
        return blocks.withColumn("split", F.lit("all"))
    rows, first = _taken(blocks, seed, label, key, lambda n: math.floor(test_size * n + 0.5))
    return rows.withColumn("split", F.when(first, "test").otherwise("train")).drop("_rank")


def side(split: DataFrame, name: str) -> DataFrame:
    """The rows of one side; the in-sample protocol gives all rows to both."""
    return split.where(F.col("split").isin(name, "all"))


def folds(blocks: DataFrame, k: int, seed=SEED, label: str = "label", key: str = "block_id") -> DataFrame:
    """Add ``fold`` in 0..k-1, each class spread evenly."""
    return _class_ranks(blocks, seed, label, key).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def stratified_sample(blocks: DataFrame, rows: int, seed=SEED, label: str = "label", key: str = "block_id") -> DataFrame:
    """About ``rows`` rows with the class shares kept; all of them if there are fewer."""
    sizes = _class_sizes(blocks, label)
    total = sum(size for _, size in sizes)
    if rows >= total:
        return blocks
    chosen, first = _taken(blocks, seed, label, key, lambda n: math.floor(rows * n / total + 0.5))
    return chosen.where(first).drop("_rank")


def unlabeled_sample(frame: DataFrame, rows: int, seed=SEED, key: str = "block_id") -> DataFrame:
    """A seeded random sample for blind checks; refuses input that carries labels."""
    leaking = [c for c in frame.columns if c.lower() in LABEL_LIKE]
    if leaking:
        raise ValueError(f"the sample must not carry labels: {leaking}")
    return frame.orderBy(seeded_hash(seed, key), key).limit(rows)


def time_halves(blocks: DataFrame, time: str = "first_seen", key: str = "block_id") -> DataFrame:
    """Add ``half``: 'early' for the first n div 2 blocks by first appearance, else 'late'."""
    half = blocks.count() // 2
    return ranked(blocks, [time, key], position="_rank").withColumn(
        "half", F.when(F.col("_rank") <= half, "early").otherwise("late")).drop("_rank")


def lines_of_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """The raw lines of a set of blocks (semi join; the optimizer broadcasts a small set)."""
    return lines.join(blocks.select("block_id"), "block_id", "left_semi")
