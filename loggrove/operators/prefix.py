"""Features of a block's first k events, for several k in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loggrove.operators.clean import known, seconds_of
from loggrove.operators.vocab import append_codes, encode
from loggrove.schema import (
    ARRIVAL_CHUNK, ARRIVAL_SEQ, ERROR_LEVELS, PREFIX_BOOKKEEPING_COLUMNS, PREFIX_FIXED_COLUMNS, PREFIX_LENGTHS, WARN_LEVELS,
)


def arrival_order(log: DataFrame) -> list[str]:
    return [c for c in (ARRIVAL_CHUNK, ARRIVAL_SEQ) if c in log.columns]


def check_lengths(ks) -> list[int]:
    ks = sorted({int(k) for k in ks})
    if not ks or ks[0] < 1:
        raise ValueError(f"prefix lengths start at 1: {ks}")
    return ks


def first_events(log: DataFrame, k: int) -> DataFrame:
    """The first k events of every block with their ``position`` (from 1).

    The rank filter becomes a per-task group limit ahead of the shuffle, so at most
    k rows per block and task travel, however large the block is.
    """
    order = Window.partitionBy("block_id").orderBy(*arrival_order(log))
    return log.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def _counts(values: Column) -> Column:
    """Map value -> times of a short list (at most k entries)."""
    distinct = F.array_sort(F.array_distinct(values))
    return F.map_from_arrays(distinct, F.transform(
        distinct, lambda d: F.size(F.filter(values, lambda v: v == d)).cast("int")))


def prefix_features(log: DataFrame, ks=PREFIX_LENGTHS, vocab: DataFrame | None = None) -> DataFrame:
    """One row per (block, k). A block shorter than k uses all its events.

    Everything gathered per (block, k) is bounded by k rows; the block's totals are
    plain sums over all rows. Both sides are grouped by block, so the join between
    them adds no shuffle of the log.
    """
    ks = check_lengths(ks)
    rows = log.where(F.col("block_id").isNotNull() & (F.trim("block_id") != "")).select(
        F.trim("block_id").alias("block_id"), *arrival_order(log),
        seconds_of(F.col("datetime")).alias("seconds"), F.upper(F.trim("log_level")).alias("level"),
        known(F.col("component")).alias("component"), known(F.col("event_type")).alias("event_type"),
        F.coalesce(F.col("block_size").cast("double"), F.lit(0.0)).alias("block_size"),
    )
    if vocab is None:
        vocab = append_codes(rows, columns=("component", "event_type"))
    totals = rows.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("total_events"), F.max("seconds").alias("block_end_seconds"))

    early = first_events(rows, ks[-1])
    early = encode(encode(early, vocab, "component"), vocab, "event_type")
    reached = F.explode(F.filter(F.lit(ks), lambda k: k >= F.col("position")))
    per_k = early.withColumn("k", reached).groupBy("block_id", "k").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.coalesce(F.max("seconds") - F.min("seconds"), F.lit(0)).alias("elapsed_seconds"),
        F.size(F.collect_set("event_type_encoded")).cast("long").alias("distinct_event_types"),
        F.size(F.collect_set("component_encoded")).cast("long").alias("distinct_components"),
        F.count_if(F.col("level").isin(*WARN_LEVELS)).alias("warn_count"),
        F.count_if(F.col("level").isin(*ERROR_LEVELS)).alias("error_count"),
        F.max(F.greatest("block_size", F.lit(0.0))).alias("block_size_max"),
        F.min_by("component_encoded", "position").alias("first_component_encoded"),
        F.min_by("event_type_encoded", "position").alias("first_event_type_encoded"),
        F.mode("component_encoded", True).alias("dominant_component_encoded"),
        F.mode("event_type_encoded", True).alias("dominant_event_type_encoded"),
        _counts(F.collect_list("event_type")).alias("type_counts"),
        F.max("seconds").alias("prefix_end_seconds"),
    )
    return per_k.join(totals, "block_id").select(
        "block_id", "k", *PREFIX_FIXED_COLUMNS, "type_counts", *PREFIX_BOOKKEEPING_COLUMNS)


def count_columns(features: DataFrame, event_types, shared: int = 0) -> DataFrame:
    """One ``count_<type>`` column per named event type, 0 where the prefix has none.

    All other types are added up in ``shared`` columns ``shared_count_<i>``, by crc32 of the type modulo
    their number, so that no type is left out however many there are.
    """
    named = features.withColumns({
        f"count_{t}": F.coalesce(F.try_element_at("type_counts", F.lit(t)), F.lit(0)) for t in event_types})
    if not shared:
        return named
    others = F.map_filter("type_counts", lambda t, _: ~F.coalesce(F.array_contains(F.lit(list(event_types)).cast("array<string>"), t), F.lit(False)))
    placed = F.transform(F.map_entries(others), lambda e: F.struct(F.pmod(F.crc32(e["key"]), F.lit(shared)).alias("at"), e["value"].alias("n")))

    def shared_count(number: int) -> Column:
        return F.aggregate(F.filter("_others", lambda e: e["at"] == number), F.lit(0), lambda total, e: total + e["n"])

    # A prefix without counts (null) has 0 of every type.
    sums = {f"shared_count_{i}": F.coalesce(shared_count(i), F.lit(0)) for i in range(shared)}
    return named.withColumn("_others", placed).withColumns(sums).drop("_others")


def model_columns(event_types, shared: int = 0) -> list[str]:
    """Model inputs in a fixed order; bookkeeping columns are never among them."""
    return [*PREFIX_FIXED_COLUMNS, *[f"count_{t}" for t in event_types], *[f"shared_count_{i}" for i in range(shared)]]
