"""Hard negatives of anchor vectors by angular triangle filtering.

Components are scaled and floored to integers; a score is the inner product of two such vectors.
Every row's angles to REFERENCES fixed directions are taken once. Rows are sorted by label, nearest
direction and the angle to it, and stored in blocks of BLOCK vectors with the range of angles to
every direction and the range of norms.

The angle between an anchor and a row is no less than the difference and no more than the sum of
their angles to any direction (and than what is left of a full turn). Its cosine, times the norms,
bounds the scores of a whole block from both sides; the bounds are widened for rounding. Only where
such an interval overlaps a score window that an anchor still needs are integer scores made, for
the anchors concerned and the block's rows in one matrix product that is exact.

Anchors go out in passes of bounded bytes, each against all blocks. A task keeps the best few of
each anchor and window, and these are merged by anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loggrove.llm.registry import query, table
from loggrove.llm.textcols import text_bytes
from loggrove.operators.ordering import ranked
from loggrove.scratch import scratch_path, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90  # a negative's score in hundredths of the positive's
ANCHORS = 100  # ids divisible by this are anchors
REFERENCES = 16
SAMPLED = 4_096  # rows that the directions are chosen from at most; all rows are indexed
BLOCK, LEAST = 256, 32  # rows of a block; blocks of at least so many end where label or direction change
PASS_BYTES = 16 << 20  # of the anchors of a pass
PENDING = 1 << 18  # candidates that a task holds before it keeps the best of them
LONGEST_NORM = 2.0 ** 31  # scores of longer vectors would leave the range of a long
_SLACK = 1e-6  # radians


def _matrix(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """Rows of scaled and floored components; shorter vectors are filled up with zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = np.floor(column.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    counts = np.diff(offsets)
    out = np.zeros((len(column), size))
    rows = np.repeat(np.arange(len(column)), counts)
    out[rows, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], counts)] = values[offsets[0]:offsets[-1]]
    return out


def angles_to(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles between all vectors and all unit directions; a zero vector is at a right angle to all."""
    lengths = np.linalg.norm(vectors, axis=1)
    return np.arccos(np.clip(vectors @ directions.T / np.where(lengths > 0, lengths, 1)[:, None], -1, 1))


def farthest(vectors: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` unit directions: each next one is the vector farthest from all before."""
    lengths = np.linalg.norm(vectors, axis=1)
    units = vectors[lengths > 0] / lengths[lengths > 0][:, None]
    if not len(units):
        return np.eye(1, vectors.shape[1])
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(count, len(units)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def valid_rows(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``vector`` of the rows that take part."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    long_enough = F.aggregate("vector", F.lit(0.0), lambda total, x: total + F.pow(F.floor(x * SCALE).cast("double"), 2)) < LONGEST_NORM ** 2
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                             F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(finite).where(long_enough)


def stored(rows: DataFrame, size: int, directions: np.ndarray) -> DataFrame:
    """The rows in blocks: ``ids``, ``labels``, ``vectors``, and ``low`` and ``high`` angles and norms."""

    def measured(batches):
        for batch in batches:
            vectors = _matrix(batch.column("vector"), size, SCALE)
            angles = angles_to(vectors, directions)
            cell = angles.argmin(axis=1) if len(vectors) else np.zeros(0, np.int64)
            both = np.column_stack([angles, np.linalg.norm(vectors, axis=1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell]),
                 _packed(vectors.astype("<i4")), _packed(both.astype("<f8"))], ["vec_id", "label", "cell", "near", "vector", "measures"])

    def blocks(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [batch.column(c).to_numpy() for c in ("vec_id", "label", "cell")]
            parts += [text_bytes(batch.column("vector"))[0].view("<i4").reshape(batch.num_rows, size),
                      text_bytes(batch.column("measures"))[0].view("<f8").reshape(batch.num_rows, -1)]
            held = parts if held is None else [np.concatenate(x) for x in zip(held, parts)]
            ends = _ends(held[1], held[2])
            if len(ends) > 1:  # the last block may go on in the next batch
                yield _blocks(held, ends[:-1])
                held = [x[ends[-2]:] for x in held]
        if held is not None:
            yield _blocks(held, _ends(held[1], held[2]))

    staged = rows.mapInArrow(measured, "vec_id long, label long, cell int, near double, vector binary, measures binary")
    order = ("label", "cell", "near", "vec_id")
    return staged.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        blocks, "ids array<long>, labels array<long>, vectors binary, low array<double>, high array<double>")


def _ends(label: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Where blocks end: after BLOCK rows, or at a change of label or direction after LEAST rows."""
    ends, start, total = [], 0, len(label)
    changes = np.flatnonzero((label[1:] != label[:-1]) | (cell[1:] != cell[:-1])) + 1
    while start < total:
        later = changes[np.searchsorted(changes, start + LEAST):]
        start = min([start + BLOCK, total, *later[:1].tolist()])
        ends.append(start)
    return np.array(ends)


def _blocks(parts: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
    ids, label, _, vectors, measures = parts
    starts = np.concatenate([[0], ends[:-1]])
    some = [slice(a, b) for a, b in zip(starts, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array([ids[x] for x in some], pa.list_(pa.int64())), pa.array([label[x] for x in some], pa.list_(pa.int64())),
         pa.array([vectors[x].tobytes() for x in some], pa.binary()),
         pa.array([measures[x].min(axis=0) for x in some], pa.list_(pa.float64())), pa.array([measures[x].max(axis=0) for x in some], pa.list_(pa.float64()))],
        ["ids", "labels", "vectors", "low", "high"])


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as a binary column."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [
        None, pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int64) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


class Anchors:
    """Anchors of a pass: their ids, labels and integer vectors, and what is needed to bound and score."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, directions: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
        self.angles = angles_to(vectors.astype(np.float64), directions)
        self._as: dict = {np.int64: vectors.astype(np.int64)}

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score that any row of a block may have with each anchor."""
        nearest = np.maximum(self.angles - high[:-1], low[:-1] - self.angles).max(axis=1)
        widest = np.minimum(self.angles + high[:-1], 2 * np.pi - self.angles - low[:-1]).min(axis=1)
        best, worst = np.cos(np.clip(nearest - _SLACK, 0, np.pi)), np.cos(np.clip(widest + _SLACK, 0, np.pi))
        room = 1e-6 + 1e-9 * self.norms * high[-1]
        most = self.norms * best * np.where(best >= 0, high[-1], low[-1])
        least = self.norms * worst * np.where(worst >= 0, low[-1], high[-1])
        return least - room, most + room

    def scores(self, of: np.ndarray, rows: np.ndarray, longest: float) -> np.ndarray:
        """Exact integer products: no partial sum exceeds the product of the norms."""
        largest = float(self.norms[of].max()) * longest
        kind = np.float32 if largest < 2 ** 24 else np.float64 if largest < 2 ** 53 else np.int64
        if kind not in self._as:
            self._as[kind] = self.vectors.astype(kind)
        return (self._as[kind][of] @ rows.astype(kind).T).astype(np.int64)


class Best:
    """The first ``keep`` candidates (highest score, then smallest id) of each of ``slots`` lists."""

    def __init__(self, slots: int, keep: int):
        self.keep, self.needed = keep, np.full(slots, np.iinfo(np.int64).min)  # what a list's next score must reach
        self._new: list[tuple] = []
        self._held, self._size = tuple(np.zeros(0, np.int64) for _ in range(3)), 0

    def add(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        self._new.append((slot, score, row))
        self._size += len(slot)
        if self._size > PENDING:
            self.settle()

    def settle(self) -> tuple:
        slot, score, row = (np.concatenate(x) for x in zip(self._held, *self._new))
        order = np.lexsort((row, ~score, slot))
        slot, score, row = slot[order], score[order], row[order]
        starts = np.searchsorted(slot, slot)
        place = np.arange(len(slot)) - starts
        last = place == self.keep - 1
        self.needed[slot[last]] = score[last]
        kept = place < self.keep
        self._held, self._new, self._size = (slot[kept], score[kept], row[kept]), [], 0
        return self._held


def _searched(blocks: DataFrame, size: int, shared, lists: int, keep: int, windows: bool) -> DataFrame:
    """``anchor``, ``list``, ``score`` and ``row`` of each task's best: of the same label, or of other labels inside the windows."""

    def run(batches):
        anchors, low, high = shared.value
        anchors = Anchors(*anchors)
        m = len(anchors.ids)
        best = Best(m * lists, keep)
        for batch in batches:
            packed, spans = text_bytes(batch.column("vectors"))
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c)[i].values.to_numpy() for c in ("ids", "labels"))
                ranges = [batch.column(c)[i].values.to_numpy() for c in ("low", "high")]
                least, most = anchors.bounds(*ranges)
                needed = best.needed.reshape(m, lists)
                own = np.unique(labels)
                if windows:
                    floor = np.maximum(needed, low)
                    asked = ((least[:, None] <= high) & (most[:, None] >= floor)).any(axis=1)
                    if len(own) == 1:
                        asked &= anchors.labels != own[0]
                else:
                    floor = needed
                    asked = (most >= floor[:, 0]) & np.isin(anchors.labels, own)
                of = np.flatnonzero(asked)
                if not len(of):
                    continue
                rows = packed[spans[i]:spans[i + 1]].view("<i4").reshape(len(ids), size)
                score = anchors.scores(of, rows, ranges[1][-1])
                same = anchors.labels[of][:, None] == labels
                if windows:
                    fits = ~same & (score <= high[of].max(axis=1)[:, None]) & (score >= floor[of].min(axis=1)[:, None])
                else:
                    fits = same & (score >= floor[of])
                a, b = np.nonzero(fits & (anchors.ids[of][:, None] != ids))
                for k in range(lists):
                    inside = slice(None)
                    if windows:
                        inside = (score[a, b] >= floor[of[a], k]) & (score[a, b] <= high[of[a], k])
                    x, y = a[inside], b[inside]
                    best.add(of[x] * lists + k, score[x, y], ids[y])
        slot, score, row = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(slot // lists), pa.array((slot % lists).astype(np.int32)), pa.array(score), pa.array(row)],
                                         ["anchor", "list", "score", "row"])

    found = blocks.mapInArrow(run, "anchor long, list int, score long, row long")
    order = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _anchor_rows(blocks: DataFrame, size: int, every: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            packed, spans = text_bytes(batch.column("vectors"))
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c)[i].values.to_numpy() for c in ("ids", "labels"))
                at = np.flatnonzero(ids % every == 0)
                rows = packed[spans[i]:spans[i + 1]].view("<i4").reshape(len(ids), size)[at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(labels[at]), _packed(rows)], ["vec_id", "label", "vector"])

    return blocks.select("ids", "labels", "vectors").mapInArrow(run, "vec_id long, label long, vector binary")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, every: int = ANCHORS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``rows`` has ``vec_id``, ``label`` and ``vector`` (see ``valid_rows``). Anchors are the rows whose id is divisible by
    ``every``; positives the first POSITIVES rows of the same label by score, negatives the first NEGATIVES rows of other
    labels whose score is LOWEST to HIGHEST hundredths of the positive's. Ties go to the smaller id.

    * Rows with a null id, label, vector or component or a component that is not finite take no part, nor do those
      whose scaled norm is 2^31 or more. Vectors of fewer components than the longest are as if filled up with zeros.
    * Rows that repeat an id are rows of their own, but no partners of each other. An anchor without positives, or a
      positive without negatives in its window (all of a negative score), gives no row.
    * An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    size = rows.agg(F.max(F.size("vector"))).first()[0]
    empty = spark.createDataFrame([], RESULT)
    if not size:
        return empty
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLED).select("vector").toArrow().column("vector").combine_chunks()
    directions = farthest(_matrix(sample, size, SCALE), REFERENCES)
    blocks = written(stored(rows, size, directions), "vector-blocks")
    anchors = written(ranked(_anchor_rows(blocks, size, every), ["vec_id", "label", "vector"], position="number"), "anchors")
    total, path = anchors.count(), scratch_path(spark, "negatives")
    for first in range(0, total, step := max(1, pass_bytes // (8 * size))):
        # At most ``pass_bytes`` of anchors.
        part = anchors.where(F.col("number").between(first + 1, first + step)).toArrow().sort_by("number").combine_chunks()
        ids, labels = part["vec_id"].to_numpy(), part["label"].to_numpy()
        vectors = text_bytes(part["vector"])[0].view("<i4").reshape(len(ids), size)
        own = (ids, labels, vectors, directions)
        shared = spark.sparkContext.broadcast((own, None, None))
        near = _searched(blocks, size, shared, 1, POSITIVES, False).select("anchor", "rank", "score", "row").toArrow()  # POSITIVES an anchor
        low, high = np.zeros((2, len(ids), POSITIVES), np.int64)
        low[:], high[:] = 1, 0  # windows that hold nothing
        at = near["anchor"].to_numpy(), near["rank"].to_numpy() - 1
        score = near["score"].to_numpy()
        whole, rest = np.divmod(score, 100)  # products with the whole score could leave the range
        low[at], high[at] = LOWEST * whole - -LOWEST * rest // 100, HIGHEST * whole + HIGHEST * rest // 100
        of, row = np.zeros((2, len(ids), POSITIVES), np.int64)
        of[at], row[at] = score, near["row"].to_numpy()
        shared = spark.sparkContext.broadcast((own, low, high))
        found = _searched(blocks, size, shared, POSITIVES, NEGATIVES, True)

        def named(batches, ids=ids, of=of, row=row):
            for batch in batches:
                a, k = batch.column("anchor").to_numpy(), batch.column("list").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a]), pa.array(row[a, k]), batch.column("rank"), batch.column("row"), pa.array(of[a, k]), batch.column("score")],
                    [c.split()[0] for c in RESULT.split(", ")])

        found.mapInArrow(named, RESULT).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path) if total else empty


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS place
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 10
"""


@query(SQL)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = valid_rows(table(spark, folder, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))
