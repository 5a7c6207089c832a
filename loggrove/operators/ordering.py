"""Global order without a one-task window.

``row_number() over (order by x)`` moves the whole table into one task. Here the
table is range-sorted, written once, and every sorted part numbers its own rows;
the parts' starting points come from a per-part total, which has at most one row
per (part, group) and is therefore safe to broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from loggrove.scratch import written

_SLOT, _PART, _LOCAL = "_slot", "_part", "_local"
_PART_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def _sorted_parts(frame: DataFrame, order: list) -> DataFrame:
    ordered = frame.orderBy(*order).withColumn(_SLOT, F.monotonically_increasing_id())
    return (
        written(ordered, "sorted")
        .withColumn(_PART, F.shiftright(F.col(_SLOT), _PART_BITS))
        .withColumn(_LOCAL, F.col(_SLOT).bitwiseAND(F.lit((1 << _PART_BITS) - 1)))
    )


def ranked(frame: DataFrame, order: list, within: tuple[str, ...] = (), totals: dict[str, Column] | None = None,
           position: str = "position") -> DataFrame:
    """Add a 1-based ``position`` in ``order`` (inside each ``within`` group) and,
    for each entry of ``totals``, an inclusive running sum of that column.

    ``within`` must be a low-cardinality grouping (a label, a vocabulary column, a
    trial number). ``order`` should end in a unique column, which also keeps the
    range partitions balanced when one sort value holds a large share of rows.
    """
    within = tuple(within)
    totals = totals or {}
    staged = frame
    for name, column in totals.items():
        staged = staged.withColumn(name, column)
    parts = _sorted_parts(staged, [*within, *order])

    sums = parts.groupBy(_PART, *within).agg(
        F.count(F.lit(1)).alias("_n"), F.min(_LOCAL).alias("_first"),
        *[F.sum(name).alias(f"_sum_{name}") for name in totals],
    )
    # One row per part and group: bounded by the number of partitions, not rows.
    earlier = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(_PART).rowsBetween(
        Window.unboundedPreceding, -1)
    starts = sums.select(
        _PART, *within,
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_base"),
        *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_base_{name}") for name in totals],
    )
    # Null-safe: rows of a null group are numbered like any other group.
    renamed = starts.withColumnsRenamed({c: f"_of{c}" for c in (_PART, *within)})
    same = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in (_PART, *within)]
    joined = parts.join(F.broadcast(renamed), same, "inner").drop(*[f"_of{c}" for c in (_PART, *within)])
    out = joined.withColumn(position, (F.col(_LOCAL) + F.col("_base")).cast("long"))
    if totals:
        local = Window.partitionBy(_PART, *within).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, 0)
        for name in totals:
            out = out.withColumn(name, F.sum(name).over(local) + F.col(f"_base_{name}"))
    return out.drop(_SLOT, _PART, _LOCAL, "_base", *[f"_base_{name}" for name in totals])


def seeded_hash(seed, *columns: str) -> Column:
    """A reproducible random order: md5 over 'seed:key', independent of partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def exact_quantiles(frame: DataFrame, column: str, probabilities) -> list[float] | None:
    """Exact linear-interpolation quantiles of one numeric column.

    The built-in exact percentile keeps every distinct value in one buffer. This
    counts equal values first (so ties combine before the shuffle), orders the
    distinct values across partitions and reads back only the two neighbours of
    each asked rank. Returns None for an empty column.
    """
    counts = (
        frame.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    parts = _sorted_parts(counts, ["_value"])
    sizes = sorted(parts.groupBy(_PART).agg(F.sum("_times")).collect())  # one row per partition
    total = sum(size for _, size in sizes)
    if not total:
        return None
    places = [p * (total - 1) for p in probabilities]
    needed = sorted({int(math.floor(x)) for x in places} | {int(math.ceil(x)) for x in places})
    local_ranks, start = [], 0
    for part, size in sizes:
        inside = [rank - start for rank in needed if start <= rank < start + size]
        if inside:
            local_ranks.append((part, start, inside))
        start += size
    asked = frame.sparkSession.createDataFrame(local_ranks, f"{_PART} long, _start long, _ranks array<long>")
    running = Window.partitionBy(_PART).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_upto")
    # Each distinct value covers the ranks [upto - times, upto) of its part.
    hits = (
        parts.join(F.broadcast(asked), _PART)
        .withColumn("_upto", F.sum("_times").over(running))
        .withColumn("_hit", F.filter("_ranks", lambda rank: (rank >= upto - F.col("_times")) & (rank < upto)))
        .where(F.size("_hit") > 0)
        .select("_start", "_hit", "_value").collect()  # at most two rows per asked probability
    )
    values = {row["_start"] + rank: row["_value"] for row in hits for rank in row["_hit"]}
    result = []
    for place in places:
        low, high = int(math.floor(place)), int(math.ceil(place))
        result.append(values[low] + (values[high] - values[low]) * (place - low))
    return result


def grouped_quantile(frame: DataFrame, column: str, probability: float, within: tuple[str, ...], name: str) -> DataFrame:
    """The exact quantile per (low-cardinality) group, as a column ``name``."""
    counts = frame.where(F.col(column).isNotNull()).groupBy(*within, F.col(column).cast("double").alias("_value")).agg(
        F.count(F.lit(1)).alias("_times"))
    running = ranked(counts, ["_value"], within=within, totals={"_upto": F.col("_times")})
    sizes = counts.groupBy(*within).agg(F.sum("_times").alias("_size"))  # one row per group
    renamed = sizes.withColumnsRenamed({c: f"_of{c}" for c in within})
    same = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in within]
    placed = running.join(F.broadcast(renamed), same).withColumn("_place", F.lit(probability) * (F.col("_size") - 1))
    covers = lambda rank: (rank >= F.col("_upto") - F.col("_times")) & (rank < F.col("_upto"))
    ends = placed.groupBy(*within).agg(
        F.max(F.when(covers(F.floor("_place")), F.col("_value"))).alias("_low"),
        F.max(F.when(covers(F.ceil("_place")), F.col("_value"))).alias("_high"),
        F.max("_place").alias("_place"))
    share = F.col("_place") - F.floor("_place")
    return ends.select(*within, (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias(name))
