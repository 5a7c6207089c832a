"""Column names, types and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

# --- fixed values: the common log schema, in order ---------------------------
STRUCTURED_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("pid", T.LongType()),
    T.StructField("log_level", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("block_id", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("destination_ip", T.StringType()),
    T.StructField("block_size", T.LongType()),
    T.StructField("raw_message", T.StringType()),
])
STRUCTURED_COLUMNS = tuple(STRUCTURED_SCHEMA.names)

# Arrival order is always two explicit columns. A chunk is a slice of the input
# that sorts before the next slice and holds a bounded number of rows, so an
# order-sensitive operator never has to put a whole (possibly huge) block in one
# task: it works per (block, chunk) and then joins the chunk edges up.
ARRIVAL_CHUNK, ARRIVAL_SEQ = "arrival_chunk", "arrival_seq"
DEFAULT_CHUNK_ROWS = 1_000_000

# --- fixed values: encoded categories and features -----------------------------
ENCODED_COLUMNS = ("component", "event_type", "source_ip", "destination_ip")
UNKNOWN = "UNKNOWN"
FEATURE_COLUMNS = (
    "hour_of_day", "is_error", "component_encoded", "event_type_encoded",
    "block_size", "event_frequency", "source_ip_encoded", "destination_ip_encoded",
)
TRAINING_FEATURES = tuple(c for c in FEATURE_COLUMNS if c != "is_error")

PREFIX_FIXED_COLUMNS = (
    "n_events", "elapsed_seconds", "distinct_event_types", "distinct_components",
    "warn_count", "error_count", "block_size_max",
    "first_component_encoded", "first_event_type_encoded",
    "dominant_component_encoded", "dominant_event_type_encoded",
)
PREFIX_BOOKKEEPING_COLUMNS = ("total_events", "prefix_end_seconds", "block_end_seconds")

# --- fixed values ----------------------------------------------------------
ANOMALY, NORMAL = "Anomaly", "Normal"
WARN_LEVELS = ("WARN", "WARNING")
ERROR_LEVELS = ("ERROR", "FATAL", "CRITICAL")
PREFIX_LENGTHS = (3, 5, 10, 20)
SEED = 42


def require_columns(frame: DataFrame, needed, what: str = "schema") -> None:
    """Refuse a frame that lacks columns, before any job runs."""
    missing = [c for c in needed if c not in frame.columns]
    if missing:
        raise ValueError(f"missing {what} columns: {missing}")
