"""Per-block features, metadata and dataset statistics.

Two steps. First every (block, category column, value) is counted, then a block's
few distinct values are folded into one row. Blocks of at most LIGHT lines are dealt
over the tasks once, a row for each line, and counted and folded where they lie.
Larger ones are counted with grouping sets, which send four rows for a line but
combine equal values before the shuffle and spread even one huge block over many
tasks. For features, lines of light blocks are encoded ahead of the shuffle, sorted by
hash where they lie and folded in Arrow batches. No step holds the rows of a heavy
block, or a value-to-count map, in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loggrove.operators.clean import known
from loggrove.operators.vocab import distinct_values, encode_values, fits_broadcast, numbered
from loggrove.schema import DEFAULT_CHUNK_ROWS, ENCODED_COLUMNS, FEATURE_COLUMNS, UNKNOWN, require_columns
from loggrove.scratch import written

REQUIRED = ("datetime", "log_level", "block_id", "block_size", *ENCODED_COLUMNS)
LIGHT = DEFAULT_CHUNK_ROWS  # lines of a block that one task counts
BUCKETS = 4096              # blocks are counted together by hash before any is counted alone
_CODES = 1 << 31


def value_counts(log: DataFrame, columns=ENCODED_COLUMNS, light: int = LIGHT) -> DataFrame:
    """(block_id, column, value, n, first_seen, is_error, block_size) per distinct value."""
    return _by_weight(log, lambda counted: counted, columns, light)


def _by_weight(log: DataFrame, fold: Callable[[DataFrame], DataFrame], columns=ENCODED_COLUMNS, light: int = LIGHT,
               fold_light: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What ``fold`` makes, block by block, of the value counts of light blocks and of heavy ones; ``fold_light`` makes
    the same of the lines of light blocks."""
    require_columns(log, REQUIRED, "cleaned")
    of_light = fold_light or (lambda lines: fold(_light_counts(lines, columns)))
    heavy = _heavy_blocks(log, light)
    if heavy is None:
        return of_light(log)
    same = log["block_id"].eqNullSafe(heavy["_heavy"])
    parts = [of_light(log.join(F.broadcast(heavy), same, "left_anti")),
             fold(_heavy_counts(log.join(F.broadcast(heavy), same, "left_semi"), columns))]
    return reduce(DataFrame.unionByName, parts)


def _heavy_blocks(log: DataFrame, light: int) -> DataFrame | None:
    """The blocks of more than ``light`` lines, if any. Blocks are counted one by one only in buckets of so many lines."""
    lines = log.where(F.col("datetime").isNotNull()).select("block_id", F.pmod(F.xxhash64("block_id"), F.lit(BUCKETS)).alias("_bucket"))
    # At most BUCKETS numbers.
    full = [r["_bucket"] for r in lines.groupBy("_bucket").count().where(F.col("count") > light).collect()]
    if not full:
        return None
    sizes = lines.where(F.col("_bucket").isin(full)).groupBy("block_id").agg(F.count(F.lit(1)).alias("_lines"))
    # At most one row per ``light`` lines of the log.
    heavy = written(sizes.where(F.col("_lines") > light).select(F.col("block_id").alias("_heavy")), "heavy-blocks")
    return None if heavy.isEmpty() else heavy


def _light_counts(log: DataFrame, columns) -> DataFrame:
    """All lines of a block are in one partition, so neither this nor a later grouping by block moves rows again."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    dealt = _rows(log, columns).repartition("block_id").select("block_id", "datetime", "block_size", "_error", values.alias("_v"))
    return dealt.groupBy("block_id", F.col("_v.column").alias("column"), F.col("_v.value").alias("value")).agg(*_measures())


def _rows(log: DataFrame, columns) -> DataFrame:
    return log.where(F.col("datetime").isNotNull()).select(
        "block_id", "datetime",
        F.coalesce(F.col("block_size").cast("double"), F.lit(0.0)).alias("block_size"),
        (F.upper("log_level") == "ERROR").cast("int").alias("_error"),
        *[known(F.col(c)).alias(c) for c in columns],
    )


def _measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first_seen"), F.max("datetime").alias("last_seen"),
            F.max(F.coalesce("_error", F.lit(0))).alias("is_error"), F.max("block_size").alias("block_size"),
            F.coalesce(F.sum("_error"), F.lit(0)).alias("error_lines")]


def _heavy_counts(log: DataFrame, columns) -> DataFrame:
    sets = [["block_id", c] for c in columns]
    counted = _rows(log, columns).groupingSets(sets, "block_id", *columns).agg(F.grouping_id().alias("_set"), *_measures())
    # Exactly one category column is grouped per row; the other ones are null.
    name = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])
    return counted.select("block_id", name.alias("column"), F.coalesce(*columns).alias("value"),
                          "n", "first_seen", "last_seen", "is_error", "block_size", "error_lines")


def _dominant(column: str, value: str) -> Column:
    """The value with the highest count; among equals the smallest."""
    of_column = F.when(F.col("column") == column, F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))
    return F.min(of_column)["v"]


def _dominant_code(column: str) -> Column:
    """The same of codes, as one number: the count, and below it the codes from the last to the first. Numbers are
    folded by hash, structs only after a sort."""
    packed = F.max(F.when(F.col("column") == column, F.col("n") * F.lit(_CODES) + (F.lit(_CODES - 2) - F.col("code"))))
    return (F.lit(_CODES - 2) - packed.bitwiseAND(F.lit(_CODES - 1))).cast("int")


def _codes_of_values(log: DataFrame, vocab: DataFrame | None) -> tuple[DataFrame, DataFrame, Callable[[str], Column]]:
    """The vocabulary; (column, value, code) of the values that lines are looked up by; and that value of a column.

    Without a vocabulary the distinct values of the log are read first: they are then cleaned and numbered once
    each, and lines are looked up by the values as they came.
    """
    if vocab is not None:
        vocab = written(vocab, "codes")
        return vocab, vocab.select("column", "value", "code"), lambda c: known(F.col(c))
    seen = written(distinct_values(log, ENCODED_COLUMNS), "values").withColumn("_known", known(F.col("value")))
    vocab = written(numbered(seen.select("column", F.col("_known").alias("value")).distinct()), "codes")
    codes = seen.join(vocab.withColumnRenamed("value", "_known"), ["column", "_known"]).select("column", "value", "code")
    return vocab, written(codes, "value-codes"), lambda c: F.coalesce(F.col(c), F.lit(UNKNOWN))


def block_features(log: DataFrame, vocab: DataFrame | None = None, light: int = LIGHT, error_lines: bool = False) -> DataFrame:
    """One row of model features per block. Ties between dominant categories go to
    the smallest code. Without a vocabulary one is built from this log. With ``error_lines``
    the number of ERROR lines (that have a time) is the last column."""
    require_columns(log, REQUIRED, "cleaned")
    vocab, codes, value_of = _codes_of_values(log, vocab)
    any_set = F.col("column") == ENCODED_COLUMNS[0]
    columns = ["block_id", *FEATURE_COLUMNS, *(["error_lines"] if error_lines else [])]

    def fold(counted: DataFrame) -> DataFrame:
        return encode_values(counted, vocab).groupBy("block_id").agg(
            F.hour(F.min("first_seen")).alias("hour_of_day"),
            F.max("is_error").alias("is_error"),
            F.max("block_size").alias("block_size"),
            F.sum(F.when(any_set, F.col("n"))).alias("event_frequency"),
            *[_dominant_code(c).alias(f"{c}_encoded") for c in ENCODED_COLUMNS],
            F.sum(F.when(any_set, F.col("error_lines"))).alias("error_lines"),
        ).select(columns)

    # A vocabulary too large to be sent to the tasks is joined with the counts.
    whole = (lambda lines: _light_features(lines, codes, value_of).select(columns)) if fits_broadcast(codes) else None
    return _by_weight(log, fold, light=light, fold_light=whole)


def _light_features(log: DataFrame, codes: DataFrame, value_of: Callable[[str], Column]) -> DataFrame:
    """Lines are encoded, dealt by block and sorted by the block's hash where they lie, so that a block's lines come together."""
    lines = log.where(F.col("datetime").isNotNull()).select(
        "block_id", F.col("datetime").cast("timestamp_ntz").alias("first_seen"),
        F.coalesce(F.col("block_size").cast("double"), F.lit(0.0)).alias("block_size"),
        F.coalesce((F.upper("log_level") == "ERROR").cast("int"), F.lit(0)).alias("is_error"),
        *[value_of(c).alias(c) for c in ENCODED_COLUMNS])
    for c in ENCODED_COLUMNS:
        of_column = codes.where(F.col("column") == c).select(F.col("value").alias(c), F.col("code").cast("int").alias(f"{c}_encoded"))
        lines = lines.join(F.broadcast(of_column), c, "left").drop(c).fillna(-1, [f"{c}_encoded"])
    # One number to sort by, which Spark does without comparing rows.
    dealt = lines.repartition("block_id").withColumn("_hash", F.xxhash64("block_id")).sortWithinPartitions("_hash")
    kinds = {"block_size": "double", "event_frequency": "long"}
    names = [f"{c} {kinds.get(c, 'int')}" for c in FEATURE_COLUMNS if c != "hour_of_day"]
    schema = ", ".join([f"block_id {log.schema['block_id'].dataType.simpleString()}", "first_seen timestamp_ntz", *names, "error_lines long"])
    return dealt.mapInArrow(_fold_sorted, schema).withColumn("hour_of_day", F.hour("first_seen"))


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of features per block of lines sorted by hash; the lines of the last hash of a batch wait for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes = batch.column("_hash").to_numpy()
        last = int(np.searchsorted(hashes, hashes[-1]))
        if last or (held and held[-1].column("_hash")[-1].as_py() != hashes[0]):
            yield _features_of([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _features_of(held)


def _features_of(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row of features per block of these lines; no line of the blocks is elsewhere."""
    table = pa.Table.from_batches(pieces).combine_chunks()
    columns = {name: table.column(name).chunk(0) for name in table.column_names}
    block = columns["block_id"].dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    values = {name: columns[name].to_numpy() for name in ("block_size", "is_error", *[f"{c}_encoded" for c in ENCODED_COLUMNS])}
    values["first_seen"] = columns["first_seen"].view(pa.int64()).to_numpy()
    if (block[1:] < block[:-1]).any():  # lines of two blocks of one hash
        order = np.argsort(block, kind="stable")
        block, values = block[order], {name: column[order] for name, column in values.items()}
        columns["block_id"] = columns["block_id"].take(pa.array(order))
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    found = {"event_frequency": np.diff(np.append(starts, len(block))), "block_size": np.maximum.reduceat(values["block_size"], starts),
             "is_error": np.maximum.reduceat(values["is_error"], starts)}
    for name in (f"{c}_encoded" for c in ENCODED_COLUMNS):
        found[name] = _dominant_codes(block, values[name].astype(np.int64))
    kinds = {"block_size": pa.float64(), "event_frequency": pa.int64()}
    names = [c for c in FEATURE_COLUMNS if c != "hour_of_day"]
    return pa.RecordBatch.from_arrays([
        columns["block_id"].take(pa.array(starts)), pa.array(np.minimum.reduceat(values["first_seen"], starts)).view(pa.timestamp("us")),
        *[pa.array(found[c]).cast(kinds.get(c, pa.int32())) for c in names],
        pa.array(np.add.reduceat(values["is_error"].astype(np.int64), starts))], names=["block_id", "first_seen", *names, "error_lines"])


def _dominant_codes(block: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The most frequent code of each block, of equally frequent ones the smallest; blocks are numbered in order."""
    pairs = np.sort(block * (2 * _CODES) + (codes + 1))
    runs = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    of_block, code = pairs[runs] // (2 * _CODES), pairs[runs] % (2 * _CODES)
    packed = np.diff(np.append(runs, len(pairs))) * _CODES + (_CODES - 1 - code)
    best = np.maximum.reduceat(packed, np.flatnonzero(np.r_[True, of_block[1:] != of_block[:-1]]))
    return _CODES - 2 - best % _CODES


def block_metadata(log: DataFrame, light: int = LIGHT) -> DataFrame:
    """First time seen, largest size and dominant texts per block. Ties go to the
    smallest text."""
    any_set = F.col("column") == ENCODED_COLUMNS[0]
    return _by_weight(log, lambda counted: counted.groupBy("block_id").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("block_size").alias("block_size"),
        *[_dominant(c, "value").alias(c) for c in ENCODED_COLUMNS],
        F.sum(F.when(any_set, F.col("n"))).alias("event_frequency"),
    ), light=light)


def dominant_values(log: DataFrame, column: str) -> DataFrame:
    """The dominant text of one category column per block."""
    return _by_weight(log, lambda counted: counted.groupBy("block_id").agg(
        _dominant(column, "value").alias(column), F.max(F.when(F.col("column") == column, F.col("n"))).alias("n")),
        (column,) if column in ENCODED_COLUMNS else ENCODED_COLUMNS)


def dataset_stats(log: DataFrame) -> DataFrame:
    """Totals and distributions as (kind, name, n), from one scan with grouping sets."""
    rows = log.where(F.col("datetime").isNotNull()).select(
        known(F.col("log_level")).alias("log_level"), known(F.col("event_type")).alias("event_type"),
        known(F.col("component")).alias("component"), F.date_format("datetime", "yyyy-MM-dd").alias("day"))
    kinds = ("log_level", "event_type", "component", "day")
    counted = rows.groupingSets([[k] for k in kinds] + [[]], *kinds).agg(F.count(F.lit(1)).alias("n"))
    kind = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in kinds], F.lit("total_events"))
    blocks = log.where(F.col("datetime").isNotNull()).select("block_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    return counted.select(kind.alias("kind"), F.coalesce(*kinds, F.lit("all")).alias("name"), "n").unionByName(
        blocks.select(F.lit("total_blocks").alias("kind"), F.lit("all").alias("name"), "n"))


def date_range(log: DataFrame) -> DataFrame:
    return log.agg(F.min("datetime").alias("first_time"), F.max("datetime").alias("last_time"))


def constant_columns(frame: DataFrame, columns, by: str | None = None) -> list[str] | dict:
    """Columns that hold one value (a null counts as a value), over all rows or, as a
    dict, per value of a low-cardinality column. One aggregate."""
    def constant(row) -> list[str]:
        return [c for c in columns
                if row[f"n_{c}"] == 0 or (row[f"lo_{c}"] == row[f"hi_{c}"] and row[f"n_{c}"] == row["_rows"])]

    rows = frame.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns],
        *[F.count(c).alias(f"n_{c}") for c in columns],
    ).collect()  # one row, or one per group
    return {row[by]: constant(row) for row in rows} if by else constant(rows[0])
