"""Operators on arrival order inside a block: positions, gaps, inversions.

A block may hold a third of all rows, so nothing here orders a whole block in one
task. Rows are ordered inside (block, arrival chunk); a second, much smaller step
orders the chunks of a block and carries counts and edge times across them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loggrove.operators.clean import seconds_of
from loggrove.operators.ordering import exact_quantiles
from loggrove.schema import ARRIVAL_CHUNK, ARRIVAL_SEQ, DEFAULT_CHUNK_ROWS


def with_chunks(log: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Make sure the log has ``arrival_chunk``; a table with only a running number
    gets one chunk per ``chunk_rows`` numbers."""
    if ARRIVAL_CHUNK in log.columns:
        return log
    return log.withColumn(ARRIVAL_CHUNK, F.floor(F.col(ARRIVAL_SEQ) / F.lit(chunk_rows)).cast("long"))


def _chunk_edges(log: DataFrame, group: list[str]) -> DataFrame:
    """Per (group, chunk): rows, first and last time; plus, from the chunks before it,
    the rows so far and the last time."""
    edges = log.groupBy(*group, ARRIVAL_CHUNK).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by("_seconds", ARRIVAL_SEQ).alias("_first"), F.max_by("_seconds", ARRIVAL_SEQ).alias("_last"),
    )
    over = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(ARRIVAL_CHUNK)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    return edges.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn(
        "_previous_last", F.lag("_last").over(over))


def positions(log: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add, per block in arrival order, ``position`` (from 0) and ``gap_seconds`` to the
    previous line (null for the first)."""
    rows = with_chunks(log, chunk_rows).withColumn("_seconds", seconds_of(F.col("datetime")))
    edges = _chunk_edges(rows, ["block_id"]).select("block_id", ARRIVAL_CHUNK, "_before", "_previous_last")
    local = Window.partitionBy("block_id", ARRIVAL_CHUNK).orderBy(ARRIVAL_SEQ)
    numbered = rows.withColumn("_local", F.row_number().over(local)).withColumn("_lag", F.lag("_seconds").over(local))
    return numbered.join(edges, ["block_id", ARRIVAL_CHUNK]).withColumns({
        "position": (F.col("_local") - 1 + F.col("_before")).cast("long"),
        "gap_seconds": F.col("_seconds") - F.when(F.col("_local") == 1, F.col("_previous_last")).otherwise(F.col("_lag")),
    }).drop("_local", "_lag", "_before", "_previous_last", "_seconds")


def _steps(log: DataFrame, group: list[str], chunk_rows: int) -> DataFrame:
    """Per (group, chunk): the largest forward step and the number of backward steps,
    with the step from the previous chunk included."""
    rows = with_chunks(log, chunk_rows).withColumn("_seconds", seconds_of(F.col("datetime"))).where(
        F.col("_seconds").isNotNull())
    local = Window.partitionBy(*group, ARRIVAL_CHUNK).orderBy(ARRIVAL_SEQ)
    inside = rows.withColumn("_step", F.col("_seconds") - F.lag("_seconds").over(local))
    chunks = inside.groupBy(*group, ARRIVAL_CHUNK).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max(F.greatest("_step", F.lit(0))).alias("_gap"), F.count_if(F.col("_step") < 0).alias("_back"),
        F.min_by("_seconds", ARRIVAL_SEQ).alias("_first"), F.max_by("_seconds", ARRIVAL_SEQ).alias("_last"),
    )
    over = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(ARRIVAL_CHUNK)
    return chunks.withColumn("_edge", F.col("_first") - F.lag("_last").over(over))


def longest_gaps(log: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Longest quiet time inside each block in arrival order; a one-line block has 0.
    Steps back in time are counted, not used."""
    return _steps(log, ["block_id"], chunk_rows).groupBy("block_id").agg(
        F.greatest(F.coalesce(F.max("_gap"), F.lit(0)), F.coalesce(F.max("_edge"), F.lit(0)), F.lit(0)).alias("longest_gap"),
        (F.sum("_back") + F.count_if(F.col("_edge") < 0)).cast("long").alias("time_inversions"),
        F.sum("_rows").cast("long").alias("lines"),
    )


def time_inversions(log: DataFrame, by: tuple[str, ...] = (), chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Lines earlier than the line before them, over the whole log or per ``by``."""
    group = list(by)
    steps = _steps(log, group, chunk_rows)
    grouped = steps.groupBy(*group) if group else steps.groupBy()
    return grouped.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("lines"),
        F.coalesce(F.sum("_back") + F.count_if(F.col("_edge") < 0), F.lit(0)).cast("long").alias("time_inversions"))


# --- fixed values: reported percentiles and candidate timeouts --------------
GAP_PERCENTILES = (0.5, 0.9, 0.95, 0.99, 0.999)
CANDIDATE_TIMEOUTS = (3600, 7200, 21600, 43200, 86400)


def timeout_coverage(gaps: DataFrame, timeouts=CANDIDATE_TIMEOUTS) -> DataFrame:
    """Share of blocks a timeout would never close early (gap at most the timeout)."""
    shares = gaps.agg(
        F.count(F.lit(1)).alias("blocks"),
        *[F.coalesce(F.count_if(F.col("longest_gap") <= t), F.lit(0)).alias(f"t{t}") for t in timeouts])
    return shares.select("blocks", F.explode(F.array(*[
        F.struct(F.lit(t).cast("long").alias("timeout"), F.col(f"t{t}").alias("covered")) for t in timeouts])).alias("r")
    ).select("r.timeout", "r.covered", "blocks", (F.col("r.covered") / F.col("blocks")).alias("coverage"))


def smallest_timeout_covering(gaps: DataFrame, share: float) -> int | None:
    """Smallest whole-second timeout that leaves at least ``share`` of blocks unbroken."""
    import math

    per_gap = gaps.groupBy("longest_gap").count()  # equal gaps combine; gaps are whole seconds
    total = per_gap.agg(F.sum("count")).first()[0]
    if not total:
        return None
    needed = max(1, math.ceil(share * total))
    # value at rank `needed` (1-based), as the exact quantile at its position
    probability = 0.0 if total == 1 else (needed - 1) / (total - 1)
    value = exact_quantiles(gaps, "longest_gap", [probability])[0]
    return int(round(value))


def gap_percentiles(gaps: DataFrame, probabilities=GAP_PERCENTILES) -> DataFrame:
    values = exact_quantiles(gaps, "longest_gap", list(probabilities))
    rows = [(float(p), v) for p, v in zip(probabilities, values or [])]
    return gaps.sparkSession.createDataFrame(rows, "percentile double, gap_seconds double")
