"""Apache error lines to structured columns; a block is a fixed time window."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loggrove.functions.templates import normalize_template
from loggrove.functions.text import first_group, group, is_match, line_groups

# --- fixed values: line layout and field patterns --------------------------
LINE = r"(?s)^\[[A-Z][a-z]{2} ([A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2} \d{4})\]\s+\[([a-z]+)\]\s*(.*)$"
CLIENT = r"^\[client ([^\]\s]+)\]\s*"
MODULE = r"(?U)^([A-Za-z_][\w.]*?)(?:\(\)|:|\s|$)"
STAMP_FORMAT = "MMM d HH:mm:ss yyyy"
DEFAULT_WINDOW_SECONDS = 60


def window_start(moment: Column, window_seconds: int) -> Column:
    """Start of the fixed window a (zone-less) moment falls in."""
    seconds = F.unix_seconds(moment.cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(window_seconds)))


def window_block_id(moment: Column, window_seconds: int = DEFAULT_WINDOW_SECONDS) -> Column:
    if window_seconds <= 0:
        raise ValueError(f"a window lasts at least one second, not {window_seconds}")
    return F.concat(F.lit("win-"), F.date_format(window_start(moment, window_seconds), "yyyyMMdd'T'HHmmss"))


def stages(line: Column) -> list[dict[str, Column]]:
    parts = F.col("_groups")
    stamp, message = (group(is_match(line, parts, 3), parts, i) for i in (1, 3))
    return [
        {"_groups": line_groups(line, LINE, 3)},
        # try_to_timestamp: a day that does not exist (Feb 30) leaves the line without a date.
        {"_moment": F.try_to_timestamp(F.regexp_replace(stamp, " +", " "), F.lit(STAMP_FORMAT)),
         "_client": first_group(message, CLIENT), "_body": F.regexp_replace(message, CLIENT, "")},
    ]


def columns(line: Column, window_seconds: int = DEFAULT_WINDOW_SECONDS) -> dict[str, Column]:
    parts = F.col("_groups")
    matched = is_match(line, parts, 3)
    level, message = (group(matched, parts, i) for i in (2, 3))
    moment, client, body = F.col("_moment"), F.col("_client"), F.col("_body")
    return {
        "date": F.date_format(moment, "yyyy-MM-dd"),
        "time": F.date_format(moment, "HH:mm:ss"),
        "pid": F.when(matched, F.lit(0).cast("bigint")),
        "log_level": F.upper(level),
        "component": F.when(client.isNotNull(), F.lit("client"))
        .when(matched, F.coalesce(first_group(body, MODULE), F.lit("core"))),
        "event_type": F.when(matched, normalize_template(body)).otherwise(F.lit("OTHER")),
        "block_id": window_block_id(moment, window_seconds),
        "source_ip": client,
        "destination_ip": F.lit(None).cast("string"),
        "block_size": F.lit(None).cast("bigint"),
        "raw_message": F.coalesce(message, line),
    }
