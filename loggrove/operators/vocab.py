"""Category vocabulary: an append-only table (column, value, code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loggrove.operators.ordering import ranked
from loggrove.schema import ENCODED_COLUMNS, UNKNOWN

# A vocabulary of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
SALTS = 32


def _as_values(frame: DataFrame, columns) -> DataFrame:
    """Long form (column, value) of the category columns."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(UNKNOWN)).alias("value")) for c in columns]))
    return frame.select(pairs.alias("_pair")).select("_pair.*")


def distinct_values(frame: DataFrame, columns) -> DataFrame:
    return _as_values(frame, columns).distinct()


def numbered(values: DataFrame) -> DataFrame:
    """Distinct (column, value) sorted and numbered from 0 in each column."""
    return ranked(values, ["value"], within=("column",)).select("column", "value", (F.col("position") - 1).cast("int").alias("code"))


def append_codes(frame: DataFrame, vocab: DataFrame | None = None, columns=ENCODED_COLUMNS) -> DataFrame:
    """The vocabulary after seeing ``frame``: old codes never move, new values are
    sorted and numbered after the highest code of their column."""
    values = distinct_values(frame, columns)
    if vocab is None:
        return numbered(values)
    fresh = values.join(vocab.select("column", "value"), ["column", "value"], "left_anti")
    highest = vocab.groupBy("column").agg(F.max("code").alias("_highest"))
    # One row per category column: a handful.
    added = ranked(fresh, ["value"], within=("column",)).join(F.broadcast(highest), "column", "left").select(
        "column", "value", (F.coalesce("_highest", F.lit(-1)) + F.col("position")).cast("int").alias("code"))
    return vocab.select("column", "value", F.col("code").cast("int").alias("code")).unionByName(added)


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``limit`` rows (reads no more than that many)."""
    return table.limit(limit + 1).count() <= limit


def lookup(frame: DataFrame, table: DataFrame, on: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join against a keyed table: broadcast when it is proven small, otherwise
    a shuffle join whose key is salted, since one value may hold most rows."""
    if fits_broadcast(table, limit):
        return frame.join(F.broadcast(table), on, "left")
    salted = frame.withColumn("_salt", F.pmod(F.xxhash64(*frame.columns), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.lit(list(range(SALTS)))))
    return salted.join(copies, [*on, "_salt"], "left").drop("_salt")


def encode_values(frame: DataFrame, vocab: DataFrame, unseen: int = -1) -> DataFrame:
    """Add ``code`` to rows of (…, column, value, …); an unseen value gets ``unseen``."""
    out = lookup(frame, vocab.select("column", "value", "code"), ["column", "value"])
    return out.withColumn("code", F.coalesce("code", F.lit(unseen)).cast("int"))


def encode(frame: DataFrame, vocab: DataFrame, column: str, unseen: int = -1) -> DataFrame:
    """Add ``<column>_encoded`` next to a category column."""
    codes = vocab.where(F.col("column") == column).select(F.col("value").alias(column), F.col("code").alias(f"{column}_encoded"))
    out = lookup(frame.withColumn(column, F.coalesce(column, F.lit(UNKNOWN))), codes, [column])
    return out.withColumn(f"{column}_encoded", F.coalesce(f"{column}_encoded", F.lit(unseen)).cast("int"))


def unseen_values(frame: DataFrame, vocab: DataFrame, columns=ENCODED_COLUMNS) -> DataFrame:
    """Distinct values the vocabulary lacks (a set difference)."""
    return _as_values(frame, columns).distinct().join(vocab.select("column", "value"), ["column", "value"], "left_anti")


def entry_digest(column: Column, value: Column, code: Column) -> Column:
    """A 60-bit number per vocabulary entry."""
    text = F.concat_ws("\x1f", column, value, code.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(vocab: DataFrame) -> DataFrame:
    """A 16-digit digest of the whole vocabulary.

    The entries' digests are added up per column, so the fingerprint does not
    depend on row order and no task ever holds the vocabulary.
    """
    per_column = vocab.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.sum(entry_digest(F.col("column"), F.col("value"), F.col("code"))).alias("digest"))
    line = F.concat_ws(":", "column", F.col("n").cast("string"), F.col("digest").cast("string"))
    # One entry per category column.
    return per_column.agg(F.concat_ws("|", F.sort_array(F.collect_list(line))).alias("text")).select(
        F.substring(F.sha2("text", 256), 1, 16).alias("fingerprint"))


def conflicts(trained: DataFrame, current: DataFrame) -> DataFrame:
    """Values whose code changed since training. Growth is fine; renumbering is not."""
    return trained.select("column", "value", F.col("code").alias("trained_code")).join(
        current.select("column", "value", F.col("code").alias("current_code")), ["column", "value"]
    ).where(F.col("trained_code") != F.col("current_code"))


def require_compatible(trained: DataFrame | None, current: DataFrame) -> None:
    """Refuse to score when the model's vocabulary is unknown or was renumbered."""
    if trained is None:
        raise ValueError("the model has no vocabulary, so its codes can not be checked against the features")
    found = conflicts(trained, current).limit(3).collect()
    if found:
        shown = "; ".join(f"{r['column']}[{r['value']}]: trained as {r['trained_code']}, now {r['current_code']}" for r in found)
        raise ValueError(f"category codes were renumbered since training: {shown}")


def sizes(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"))
