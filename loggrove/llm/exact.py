"""Exact deduplication by block naming.

Every normalised text is cut into blocks of a fixed number of code points. The distinct blocks
are sorted and the place in that order is a block's integer name. Adjacent names form pairs, the
distinct pairs are sorted and named in turn, and so on until each document has one name. Two
documents of equally many blocks have the same name exactly when their texts are equal.

Block texts move once: partial aggregation leaves one copy per task, and only the distinct
blocks are sorted. A document keeps two 64-bit digests of each of its blocks, through which it
finds the names. Digests never decide equality: the sorted blocks themselves show whether two
different blocks share digests, and then the naming is repeated under the next seed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from loggrove.llm.registry import query, table
from loggrove.scratch import written

BLOCK_CHARS = 4096
BLANKS = " \t\n\x0b\x0c\r"  # the bytes 20 and 09 to 0D
NONE = -1  # stands for the missing right half of a lone last name

Digest = Callable[[Column, int], list[Column]]


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)]


def _blocks(text: Column, size: int) -> Column:
    """The text's blocks; an empty text is one empty block."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _names(distinct: DataFrame, order: list[str], label: str) -> DataFrame:
    """Distinct rows with an integer ``name``: their place in the sorted parts."""
    kept = [c for c in distinct.columns if c != "block"]
    named = distinct.sortWithinPartitions(*order).select(*kept, F.monotonically_increasing_id().alias("name"))
    return written(named, label)


def identities(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = BLOCK_CHARS,
               digest: Digest = digests, seed: int = 0) -> DataFrame:
    """One row per input row: the ``keep`` columns, ``n_points`` (code points of the original
    text), ``text_sha256`` of the normalised text, and the identity (``n_blocks``, ``name``)."""
    staged = docs.select(
        *[F.col(c) for c in keep], F.coalesce(F.length(text_column), F.lit(0)).alias("n_points"),
        normalised(F.col(text_column)).alias("_norm"))
    cut = staged.withColumn("_blocks", _blocks(F.col("_norm"), size))
    for attempt in range(seed, seed + 64):
        per_block = F.transform("_blocks", lambda b: F.struct(
            *[d.alias(n) for d, n in zip(digest(b, attempt), ("h1", "h2"))]))
        rows = written(cut.select(
            F.monotonically_increasing_id().alias("_row"), *keep, "n_points", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
            F.size("_blocks").cast("long").alias("n_blocks"), per_block.alias("_digests")), "rows")
        blocks = cut.select(F.explode("_blocks").alias("block"))
        distinct = blocks.select(*[d.alias(n) for d, n in zip(digest(F.col("block"), attempt), ("h1", "h2"))], "block").distinct()
        names = _names(distinct, ["block"], "block-names")
        if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no seed tells the blocks apart")

    units = rows.select("_row", "n_blocks", F.posexplode("_digests").alias("place", "d")).select(
        "_row", "n_blocks", F.col("place").cast("long").alias("place"), F.col("d.h1").alias("h1"), F.col("d.h2").alias("h2"))
    units = units.join(names, ["h1", "h2"]).select("_row", "n_blocks", "place", "name")
    longest = rows.agg(F.max("n_blocks")).first()[0] or 0
    if longest <= 1:
        whole = units.select("_row", "name")
    else:
        units = written(units, "units")
        whole = units.where("n_blocks = 1").select("_row", "name")
        units = units.where("n_blocks > 1").select("_row", "place", "name")
        while longest > 1:
            half = F.col("place") % 2 == 0
            pairs = units.groupBy("_row", F.floor(F.col("place") / 2).alias("place")).agg(
                F.max(F.when(half, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(NONE).cast("long")).alias("right"))
            pairs = written(pairs, "pairs")
            names = _names(pairs.select("left", "right").distinct(), ["left", "right"], "pair-names")
            units = pairs.join(names, ["left", "right"]).select("_row", "place", "name")
            longest = (longest + 1) // 2
        whole = whole.unionByName(units.select("_row", "name"))
    return rows.drop("_digests").join(whole, "_row").drop("_row")


def exact_groups(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", size: int = BLOCK_CHARS,
                 digest: Digest = digests) -> DataFrame:
    """Groups of rows whose texts are equal apart from blanks (bytes 20 and 09 to 0D).

    Returns one row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``. In each group the row with the most code points in the original text
    stays, then the smallest id; null ids come last.

    * A null text counts as empty; all empty and blank texts are one group.
    * Rows that repeat an id with an equal text are all marked as kept if that id stays: ids
      name documents, and the caller drops repeated rows of one id, as ``deduplicated`` does.
    * A null id is never preferred over another id of equal length. An empty table gives none.
    * Other columns are not read, whatever their names.
    """
    source = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    rows = identities(source, "_text", ("_id",), size, digest)
    # Written, so that the join's large parts can be split at run time.
    groups = written(rows.groupBy("n_blocks", "name").agg(
        F.min(F.struct((-F.col("n_points")).alias("length"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))).alias("best"),
        F.count(F.lit(1)).alias("group_size")), "groups")
    return rows.join(groups, ["n_blocks", "name"]).select(
        F.col("_id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size",
        F.col("_id").eqNullSafe(F.col("best.id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that ``exact_groups`` keeps, with all their columns, one row per kept text.

    Rows that repeat both id and normalised text leave one row: the longest original text, then the
    first by text. Rows that repeat an id with different texts are separate documents.
    """
    tagged = docs.withColumn("_sha", F.sha2(normalised(F.col("text")).cast("binary"), 256))
    kept = exact_groups(docs).where("kept").select(
        F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_kept_sha"), "group_size").groupBy("_kept", "_kept_sha").agg(
        F.count(F.lit(1)).alias("_copies"))
    joined = tagged.join(kept, tagged["doc_id"].eqNullSafe(kept["_kept"]) & (tagged["_sha"] == kept["_kept_sha"]))
    single = joined.where("_copies = 1").select(*docs.columns)
    # Repeated rows of one id: few, so ordering them costs little.
    order = Window.partitionBy("_kept", "_kept_sha").orderBy(F.length("text").desc(), "text")
    repeated = joined.where("_copies > 1").withColumn("_turn", F.row_number().over(order)).where("_turn = 1").select(*docs.columns)
    return single.unionByName(repeated)


SQL = r"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


@query(SQL)
def op1_exact_dedup(spark, folder):
    return exact_groups(table(spark, folder, "documents"))
