"""Message text to event template, as nested column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: placeholder patterns, in the order they are applied ------
# (?U) gives \\w \\d \\s \\b their Unicode meaning.
TEMPLATE_PATTERNS = (
    (r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"(?U)\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<ip>"),
    (r"(?U)(?:(?<=\s)|^)(?:[a-zA-Z]+://)?[\w.-]*(?:/[^\s\"',;)\]]*)+", "<path>"),
    (r"(?U)\b(?:0x)?[0-9a-fA-F]*\d[0-9a-fA-F]*\b(?=[^a-zA-Z]|$)", "<n>"),
    (r"(?U)\s+", " "),
)
TEMPLATE_LENGTH = 120
EMPTY_TEMPLATE = "<empty>"


def normalize_template(message: Column) -> Column:
    """Replace ids, addresses, paths and numbers by placeholders; squeeze blanks;
    keep the first 120 characters; an empty message becomes ``<empty>``."""
    text = F.coalesce(message, F.lit(""))
    for pattern, placeholder in TEMPLATE_PATTERNS:
        text = F.regexp_replace(text, pattern, placeholder)
    return F.coalesce(F.nullif(F.substring(F.trim(text), 1, TEMPLATE_LENGTH), F.lit("")), F.lit(EMPTY_TEMPLATE))
