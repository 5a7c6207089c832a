"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; a document's expected copies are its source's target
over the source's size. Within a source the expected copies are summed up in the order of size
and id, a random offset is added once, and a document is emitted once for every integer that
its part of the running sum crosses. As documents of like size are neighbours, the taken words
come within about one long document of the target.

All copies of a source are expected equally often, so the running sum at a document is its rank
times that number. Ranks come from a range sort whose parts number their own rows, so a source
that holds a third of all rows is spread over many tasks. What one task sees whole is one row
per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loggrove.llm.registry import query, table
from loggrove.operators.ordering import ranked
from loggrove.scratch import written

WEIGHTS = (5, 2, 1)  # repeating over the sources by code point, null last
MOST = 3  # a target stops at so many times its source's size
SEED = "mix"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``rate`` and ``offset`` for one row per source.

    The level L solves sum(min(most * size, weight * L)) = sum(size). Sources stop in the order
    of most * size / weight, so running sums in that order give L: it is what sharing the excess
    again and again ends at. All sums are of integers; one division gives each target.
    """
    name = [F.col("source").isNull(), F.col("source")]
    turn = F.row_number().over(Window.orderBy(*name)) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn % len(weights) + 1).cast("int"))
    staged = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), *name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    staged = staged.select(
        "*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
        F.sum("source_size").over(Window.partitionBy()).alias("total"), F.sum("weight").over(Window.partitionBy()).alias("all_weights"))
    left, shares = F.col("total") - F.col("cap_before"), F.col("all_weights") - F.col("weight_before")
    # A source stops if sharing what is left with those that stop later would exceed its cap.
    staged = staged.withColumn("stops", left * F.col("weight") >= F.col("cap") * shares)
    free = ~F.col("stops")
    whole = Window.partitionBy()
    rest = F.max(F.when(free, left)).over(whole)
    rest_shares = F.max(F.when(free, shares)).over(whole)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise((F.col("weight") * rest).cast("double") / rest_shares.cast("double"))
    # The offset is a multiple of 2^-20, so that adding it to a whole number is exact.
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)
    return staged.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size").cast("double")).otherwise(F.lit(0.0)).alias("rate"), offset.alias("offset"))


def with_copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of ``sized`` (with ``doc_id``, ``source`` and ``size`` in words) and ``source_size``, ``target``, ``copies``.

    * A null text or one of blanks alone has size 0; it moves no sum but is emitted like the rest.
    * A null source is a source of its own, last in order, apart from the empty name.
    * Sources of size 0 have target 0 and are not taken; an empty table gives an empty result.
    * Repeated rows are separate documents. Null ids come last among equal sizes.
    """
    order = [F.col("size"), F.col("doc_id").isNull(), F.col("doc_id")]
    placed = ranked(sized, order, within=("source",), position="_rank")
    sums = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, seed)
    renamed = sums.withColumnRenamed("source", "_source")
    # One row per source; the optimizer broadcasts it if its size allows.
    joined = placed.join(renamed, placed["source"].eqNullSafe(renamed["_source"]), "left")
    upto = lambda rank: F.floor(rank.cast("double") * F.col("rate") + F.col("offset"))
    copies = upto(F.col("_rank")) - upto(F.col("_rank") - 1)
    return joined.withColumn("copies", copies).drop("_rank", "_source", "rate", "offset")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all columns and ``copy`` from 1 on.

    See ``with_copies``. Columns of ``docs`` keep their names and values; its ``copy``, if any, is replaced.
    Only ids and sizes are sorted; texts meet their copies in one join on id, source and size. Rows that
    repeat all three share a range of ranks, dealt out in the order of a hash of the text.
    """
    key = ["doc_id", "source", "size"]
    order = [F.col("size"), F.col("doc_id").isNull(), F.col("doc_id")]
    packed = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    groups = written(packed.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    several = F.col("rows") > 1
    placed = ranked(groups, order, within=("source",), totals={
        "upto": F.col("rows"), "upto_repeated": F.when(several, F.col("rows")).otherwise(F.lit(0))})
    sums = targets(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), **settings)
    renamed = sums.select(F.col("source").alias("_source"), "rate", "offset")
    rated = placed.join(renamed, placed["source"].eqNullSafe(renamed["_source"]), "left")
    passed = lambda rank: F.floor(rank.cast("double") * F.col("rate") + F.col("offset"))
    asked = written(rated.withColumn("taken", passed(F.col("upto")) - passed(F.col("upto") - F.col("rows"))).where((F.col("taken") > 0) | several).select(
        *[F.col(c).alias(f"_{c}") for c in key], "rows", "upto", "upto_repeated", "taken", "rate", "offset"), "mix-copies")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    taken = packed.join(asked.where(~several), same).select("row", "taken")
    if not asked.where(several).isEmpty():
        repeated = packed.join(asked.where(several), same).withColumn("hash", F.xxhash64("row.text"))
        repeated = ranked(repeated, [*order, F.col("hash")], within=("source",))
        rank = F.col("upto") - F.col("upto_repeated") + F.col("position")
        taken = taken.union(repeated.select("row", (passed(rank) - passed(rank - 1)).alias("taken")).where("taken > 0"))
    out = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("taken"))).alias("_copy"))
    return out.select("row.*", "_copy").withColumn("copy", F.col("_copy")).drop("_copy")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap,
  coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  coalesce(sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before,
  sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights FROM s),
f AS (SELECT *, (total - cap_before) * weight >= cap * (all_weights - weight_before) AS stops FROM c),
t AS (SELECT source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE CAST(weight * max(CASE WHEN NOT stops THEN total - cap_before END) OVER () AS DOUBLE)
  / CAST(max(CASE WHEN NOT stops THEN all_weights - weight_before END) OVER () AS DOUBLE) END AS target,
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 5) AS BIGINT) AS DOUBLE) / CAST(1048576 AS DOUBLE) AS u FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0 END AS rate,
  CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS DOUBLE) AS n FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(n * rate + u) - floor((n - 1) * rate + u) AS BIGINT) * size AS taken FROM r
"""


@query(SQL)
def op4_source_mix(spark, folder):
    docs = table(spark, folder, "documents")
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")  # texts are read once
    return with_copies(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
