"""Django request lines to structured columns; a block is one user."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loggrove.functions.templates import normalize_template
from loggrove.functions.text import group, is_match, line_groups

# --- fixed values: line layout and field patterns --------------------------
LINE = (
    r"(?s)^\[(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2})(?:,\d+)?\]\s+([A-Z]+)\s+([\w.]+)\s+"
    r"user=(\S+)\s+ip=(\S+)\s+\"([A-Z]+) (\S+) [^\"]*\"\s+(\d{3})\s+(\d+)\s+\d+ms\s*(.*)$"
)
ID_SEGMENT = r"/\d+(?=/|$)"
AFTER_STAMP = r"(?s)^[^\]]*\].(.*)$"
LONGEST_PLAIN_EVENT = 120


def route(path: Column) -> Column:
    """Path without its query string, ids replaced."""
    return F.regexp_replace(F.substring_index(path, "?", 1), ID_SEGMENT, "/<n>")


def stages(line: Column) -> list[dict[str, Column]]:
    parts = F.col("_groups")
    method, path, status, detail = (group(is_match(line, parts, 11), parts, i) for i in (7, 8, 9, 11))
    slow = F.when(F.lower(detail).contains("slow request"), F.lit("SLOW"))
    return [
        {"_groups": line_groups(line, LINE, 11)},
        {"_event": F.concat_ws(" ", method, route(path), status, slow)},
    ]


def columns(line: Column) -> dict[str, Column]:
    parts = F.col("_groups")
    matched = is_match(line, parts, 11)
    day, clock, level, component, user, ip = (group(matched, parts, i) for i in range(1, 7))
    size = group(matched, parts, 10)
    event = F.col("_event")
    event = F.when(F.length(event) > LONGEST_PLAIN_EVENT, normalize_template(event)).otherwise(event)
    return {
        "date": day,
        "time": clock,
        "pid": F.when(matched, F.lit(0).cast("bigint")),
        "log_level": level,
        "component": component,
        "event_type": F.when(matched, event).otherwise(F.lit("OTHER")),
        "block_id": F.concat(F.lit("user-"), user),
        "source_ip": ip,
        "destination_ip": F.lit(None).cast("string"),
        "block_size": size.try_cast("bigint"),
        "raw_message": F.when(matched, F.regexp_extract(line, AFTER_STAMP, 1)).otherwise(line),
    }
