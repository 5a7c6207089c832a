"""Cleaning: coercion, required fields, exact-duplicate removal, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loggrove.functions.stats import count_if
from loggrove.functions.text import fenced, strip_blanks
from loggrove.schema import ARRIVAL_CHUNK, ARRIVAL_SEQ, STRUCTURED_COLUMNS, UNKNOWN, require_columns

# --- fixed values ----------------------------------------------------------
MISSING_TEXT = ("", "<NA>")
TEXT_COLUMNS = ("log_level", "component", "event_type", "block_id", "raw_message")
ADDRESS_COLUMNS = ("source_ip", "destination_ip")


def present(column: Column) -> Column:
    """Trimmed text, or null where it is null, empty or the text ``<NA>``."""
    text = strip_blanks(column)
    for missing in MISSING_TEXT:
        text = F.nullif(text, F.lit(missing))
    return text


def known(column: Column) -> Column:
    return F.coalesce(present(column), F.lit(UNKNOWN))


def moment(date: Column, clock: Column) -> Column:
    """Zone-less timestamp from the date and time texts, null when not a real time."""
    return F.try_to_timestamp(F.concat(strip_blanks(date), F.lit(" "), strip_blanks(clock))).cast("timestamp_ntz")


def seconds_of(column: Column) -> Column:
    """Epoch seconds of a zone-less timestamp (the session zone is UTC)."""
    return F.unix_seconds(column.cast("timestamp"))


def recognized(frame: DataFrame) -> DataFrame:
    """Lines the parser understood and that belong to a block."""
    return frame.where(F.col("date").isNotNull() & F.col("block_id").isNotNull())


def coerce(frame: DataFrame) -> DataFrame:
    """Typed, trimmed columns; what can not be read becomes null (or 0 / UNKNOWN)."""
    require_columns(frame, STRUCTURED_COLUMNS)
    replaced = {
        "datetime": moment(F.col("date"), F.col("time")),
        "date": strip_blanks(F.col("date")),
        "time": strip_blanks(F.col("time")),
        "pid": F.col("pid").cast("string").try_cast("double").try_cast("bigint"),
        "block_size": F.coalesce(F.col("block_size").cast("string").try_cast("double"), F.lit(0.0)),
        **{c: present(F.col(c)) for c in TEXT_COLUMNS},
        **{c: known(F.col(c)) for c in ADDRESS_COLUMNS},
    }
    return fenced(frame.withColumns(replaced), replaced)


def valid() -> Column:
    """Whether a coerced row has all required fields."""
    condition = F.col("datetime").isNotNull() & F.col("pid").isNotNull()
    for column in TEXT_COLUMNS:
        condition = condition & F.col(column).isNotNull()
    return condition


def drop_invalid(frame: DataFrame) -> DataFrame:
    return frame.where(valid())


def drop_exact_duplicates(frame: DataFrame) -> DataFrame:
    """One row per distinct content, keeping the first arrival.

    A plain grouping, so copies of one line combine before the shuffle however
    many there are.
    """
    order = [c for c in (ARRIVAL_CHUNK, ARRIVAL_SEQ) if c in frame.columns]
    keys = [c for c in frame.columns if c not in order]
    if not order:
        return frame.dropDuplicates(keys)
    if len(order) == 1:
        return frame.groupBy(*keys).agg(F.min(order[0]).alias(order[0]))
    return frame.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first")).select(*keys, "_first.*")


def clean(frame: DataFrame, dedupe: bool = True) -> DataFrame:
    """Cleaned log rows: the structured columns, ``datetime`` and arrival order."""
    cleaned = drop_invalid(coerce(frame))
    return drop_exact_duplicates(cleaned) if dedupe else cleaned


def ingest_stats(structured: DataFrame, dedupe: bool = True) -> DataFrame:
    """One row of counts: what was read, recognized, dropped and kept."""
    raw = structured.agg(
        F.count(F.lit(1)).alias("lines_or_records"),
        count_if(F.col("date").isNull()).alias("unparsed"),
        count_if(F.col("date").isNotNull() & F.col("block_id").isNull()).alias("no_block_id"),
    )
    cleaned = clean(recognized(structured), dedupe)
    # Two levels, so counting blocks never gathers one block's rows or all block ids.
    per_block = cleaned.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    kept = per_block.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events_after_cleaning"), F.count(F.lit(1)).alias("blocks"))
    kept_row = kept.select(F.struct("*")).scalar()
    out = raw.withColumn("recognized", F.col("lines_or_records") - F.col("unparsed") - F.col("no_block_id"))
    out = out.withColumn("_kept", kept_row)
    return out.select(
        "lines_or_records", "unparsed", "no_block_id", "recognized",
        (F.col("recognized") - F.col("_kept.events_after_cleaning")).alias("dropped_by_cleaner"),
        F.col("_kept.events_after_cleaning").alias("events_after_cleaning"),
        F.col("_kept.blocks").alias("blocks"),
    )
