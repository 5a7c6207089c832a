"""OpenStack nova lines to structured columns; a block is one VM session."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loggrove.functions.templates import normalize_template
from loggrove.functions.text import first_group, group, is_match, line_groups

# --- fixed values: line layout and field patterns --------------------------
LINE = (
    r"(?s)^(?:\S+)\s+(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})(?:\.\d+)?\s+"
    r"(\d+)\s+([A-Z]+)\s+(\S+)\s+\[([^\]]*)\]\s?(.*)$"
)
INSTANCE = r"\[instance:\s*([0-9a-fA-F-]{36})\]"
REQUEST = r"^(req-[0-9a-fA-F-]{36})"
IP = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
LENGTH = r"\blen:\s*(\d+)"


def block_id(message: Column) -> Column:
    return first_group(message, INSTANCE)


def stages(line: Column) -> list[dict[str, Column]]:
    return [{"_groups": line_groups(line, LINE, 7)}]


def columns(line: Column, fallback_to_request_id: bool = False) -> dict[str, Column]:
    parts = F.col("_groups")
    matched = is_match(line, parts, 7)
    day, clock, pid, level, component, context, message = (group(matched, parts, i) for i in range(1, 8))
    block = block_id(message)
    if fallback_to_request_id:
        block = F.coalesce(block, first_group(F.trim(context), REQUEST))
    return {
        "date": day,
        "time": clock,
        "pid": pid.try_cast("bigint"),
        "log_level": level,
        "component": component,
        "event_type": F.when(matched, normalize_template(F.regexp_replace(message, INSTANCE, ""))).otherwise(F.lit("OTHER")),
        "block_id": block,
        "source_ip": first_group(message, IP),
        "destination_ip": F.lit(None).cast("string"),
        "block_size": first_group(message, LENGTH).try_cast("bigint"),
        "raw_message": F.coalesce(message, line),
    }
