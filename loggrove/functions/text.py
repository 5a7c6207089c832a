"""Regex and white-space helpers that keep one regex evaluation per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_MARK = "\x01"
# --- fixed values: every character Unicode calls white space ----------------
BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")


def line_groups(line: Column, pattern: str, groups: int) -> Column:
    """The groups of an anchored pattern as an array, from one regex evaluation.

    Asking regexp_extract for each group runs the pattern once per group. Here one
    regexp_replace rewrites a matching line as its groups, each after a control
    character, and a split takes them apart: element 0 is then empty and groups
    follow. The split is limited, so the last group keeps any further control
    characters. Put the result in a column of its own before using its elements.
    """
    rewritten = F.regexp_replace(line, pattern, "".join(f"{_MARK}${i}" for i in range(1, groups + 1)))
    return F.split(rewritten, _MARK, groups + 1)


def is_match(line: Column, parts: Column, groups: int) -> Column:
    """Whether ``parts`` came from a matching line. A line that itself starts with the
    control character can not match a pattern that begins with visible text."""
    return (F.size(parts) == groups + 1) & (parts[0] == "") & ~line.startswith(_MARK)


def group(matched: Column, parts: Column, number: int) -> Column:
    return F.when(matched, F.get(parts, F.lit(number)))


def first_group(text: Column, pattern: str, group_number: int = 1) -> Column:
    """The group of the first match, or null when there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group_number), F.lit(""))


def first_of(name: str, text: Column, patterns) -> list[dict[str, Column]]:
    """The group of the first pattern, in list order, that matches: helper columns to be
    computed one after the other, so that a later pattern only runs where all earlier
    ones failed and none runs twice. The result is '' where nothing matched."""
    steps = [{name: F.regexp_extract(text, patterns[0], 1)}]
    for pattern in patterns[1:]:
        steps.append({name: F.when(F.col(name) == "", F.regexp_extract(text, pattern, 1)).otherwise(F.col(name))})
    return steps


def strip_blanks(text: Column) -> Column:
    """Trim all Unicode white space, not only the space character."""
    return F.trim(text, F.lit(BLANKS))


def fenced(frame: DataFrame, columns) -> DataFrame:
    """The same frame, with ``columns`` computed once and before any later filter.

    The optimizer pushes a filter below the projection that computes its columns by
    copying their expressions, so every pattern or parse would run twice. It does not
    copy through a generator, and a generator over a one-element array changes nothing.
    """
    columns = list(columns)
    rest = [c for c in frame.columns if c not in columns]
    return frame.select(*rest, F.inline(F.array(F.struct(*columns))))
