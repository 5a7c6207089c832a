"""HDFS data-node lines to structured columns."""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column, functions as F

from loggrove.functions.text import first_group, first_of, group, is_match, line_groups

# --- fixed values: line layout, taxonomy and field patterns ----------------
LINE = r"(?s)^(\d{6})\s+(\d{6})\s+(\d+)\s+([A-Z]+)\s+([^:]+):\s+(.*)$"
BLOCK_ID = r"\bblk_-?\d+\b"
BLOCK_SIZE = r"(?i)\b(?:of\s+)?size\s+(\d+)\b"
IP = r"(\d{1,3}(?:\.\d{1,3}){3})"
SOURCE_IP = (
    rf"\bsrc:\s*/?{IP}(?::\d+)?",
    rf"\bfrom\s+/?{IP}(?::\d+)?",
    rf"^/?{IP}(?::\d+)?(?::)?",
    rf"\bask\s+/?{IP}(?::\d+)?\s+to\s+replicate\b",
    rf"\bblockMap updated:\s+/?{IP}(?::\d+)?\s+is added\b",
)
DESTINATION_IP = (
    rf"\bdest:\s*/?{IP}(?::\d+)?",
    rf"\bto\s+/?{IP}(?::\d+)?",
    rf"\bto datanode\(s\)\s+/?{IP}(?::\d+)?",
)
EVENT_TYPES = (
    (r"\bReceiving block\b", "RECEIVE_BLOCK"),
    (r"\bReceived block\b", "RECEIVED_BLOCK"),
    (r"(?s)\bPacketResponder\b.*\bterminating\b", "PACKET_TERMINATED"),
    (r"\bNameSystem\.allocateBlock\b", "ALLOCATE_BLOCK"),
    (r"\bNameSystem\.addStoredBlock\b", "STORE_BLOCK"),
    (r"\bServed block\b", "SERVE_BLOCK"),
    (r"\bStarting thread to transfer block\b", "START_TRANSFER"),
    (r"\bTransmitted block\b", "TRANSMIT_BLOCK"),
    (r"(?i)\breplicate\b", "REPLICATE_BLOCK"),
)
OTHER = "OTHER"


def classify(message: Column) -> Column:
    """The first matching event type in list order, else OTHER."""
    chosen = F.when(message.rlike(EVENT_TYPES[0][0]), F.lit(EVENT_TYPES[0][1]))
    for pattern, name in EVENT_TYPES[1:]:
        chosen = chosen.when(message.rlike(pattern), F.lit(name))
    return chosen.otherwise(F.lit(OTHER))


def block_id(message: Column) -> Column:
    return first_group(message, BLOCK_ID, 0)


def stages(line: Column) -> list[dict[str, Column]]:
    parts, body = F.col("_groups"), F.col("_body")
    sources, targets = first_of("_source", body, SOURCE_IP), first_of("_target", body, DESTINATION_IP)
    return [
        {"_groups": line_groups(line, LINE, 6)},
        {"_body": F.coalesce(group(is_match(line, parts, 6), parts, 6), line)},
        *[{**one, **other} for one, other in zip_longest(sources, targets, fillvalue={})],
    ]


def columns(line: Column) -> dict[str, Column]:
    parts, body = F.col("_groups"), F.col("_body")
    matched = is_match(line, parts, 6)
    day, clock, pid, level, component = (group(matched, parts, i) for i in range(1, 6))
    return {
        "date": F.date_format(F.try_to_timestamp(day, F.lit("yyMMdd")), "yyyy-MM-dd"),
        "time": F.regexp_replace(clock, r"^(\d\d)(\d\d)(\d\d)$", "$1:$2:$3"),
        "pid": pid.try_cast("bigint"),
        "log_level": level,
        "component": component,
        "event_type": F.when(matched, classify(body)).otherwise(F.lit(OTHER)),
        "block_id": block_id(body),
        "source_ip": F.nullif(F.col("_source"), F.lit("")),
        "destination_ip": F.nullif(F.col("_target"), F.lit("")),
        "block_size": first_group(body, BLOCK_SIZE).try_cast("bigint"),
        "raw_message": body,
    }
