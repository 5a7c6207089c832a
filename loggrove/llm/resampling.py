"""Resampling documents towards a target distribution by importance weights.

A document's features are its words and pairs of neighbouring words, hashed to BUCKETS buckets by
CRC-32. A bucket's gain is the logarithm of how much more often the target texts use it than the
corpus does; a document's weight is the mean gain of its features. A Gumbel number, fixed by the
document's id, is added, and the documents of the highest sums are drawn: that is sampling without
replacement with chances in proportion to exp(weight).

CRCs are made in length-bucketed matrices. The distinct words of a slice of texts, and the distinct
pairs of them, are put into two-dimensional byte arrays by equal length; all CRCs of such a matrix
move on column by column, and the buckets are scattered back to where the features stand. Few
texts have features of over LONGEST bytes; these are hashed one by one, as a matrix of them
would have more columns than rows.

Texts are hashed once: the buckets are written, two bytes a feature, and both the counts and the
weights are taken from there. Only the counts of the buckets come to the driver.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loggrove.llm.registry import query, table
from loggrove.llm.textcols import LOWER, SEGMENT, _table, cut_segments, slices, text_bytes, word_starts
from loggrove.operators.ordering import ranked
from loggrove.scratch import written

BUCKETS = 10_000
LEAST_WORDS = 20  # shorter documents are not drawn
PERCENT = 25  # of the others are drawn
SEED = "7"
LONGEST = 256  # bytes of a feature that goes into a matrix

IS_WORD = _table(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))


def _crc_steps() -> np.ndarray:
    """What each byte does to a CRC-32 (polynomial EDB88320, reflected)."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1).astype(np.uint32)
    return steps


_STEPS = _crc_steps()


def matrix_crcs(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a matrix of bytes, column by column."""
    state = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        state = _STEPS[(state ^ column) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
    return ~state


def _distinct_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each distinct one of a matrix of bytes, and which of these each row is. Exact: no hashes."""
    rows, length = matrix.shape
    wide = np.zeros((rows, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = matrix
    packed = wide.view(np.uint64)
    first, ids = np.unique(packed[:, 0], return_index=True, return_inverse=True)[1:]
    for column in packed.T[1:]:
        values = np.unique(column, return_inverse=True)[1]
        first, ids = np.unique(ids.astype(np.int64) * (int(values.max()) + 1) + values, return_index=True, return_inverse=True)[1:]
    return first, ids


def _by_length(lengths: np.ndarray):
    """(length, places of that length) for every distinct length."""
    order = np.argsort(lengths, kind="stable")
    found, starts = np.unique(lengths[order], return_index=True)
    for length, places in zip(found, np.split(order, starts[1:])):
        yield int(length), places


def _words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which distinct word each word is, and the place of a representative of each distinct word."""
    ids, places = np.zeros(len(starts), np.int64), []
    known = 0
    for length, of in _by_length(lengths):
        if length <= LONGEST:
            first, own = _distinct_rows(data[starts[of][:, None] + np.arange(length)])
        else:
            seen: dict[bytes, int] = {}
            own = np.array([seen.setdefault(data[s:s + length].tobytes(), len(seen)) for s in starts[of]])
            first = np.unique(own, return_index=True)[1]
        ids[of] = own + known
        places.append(of[first])
        known += len(first)
    return ids, np.concatenate(places)


def _crcs(data: np.ndarray, first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """CRC-32 of features: the words at ``first`` (starts, lengths), with a blank and those at ``second`` if given."""
    starts, lengths = first
    total = lengths if second is None else lengths + 1 + second[1]
    out = np.zeros(len(starts), np.uint32)
    for length, of in _by_length(total):
        if length > LONGEST:
            for i in of:
                state = zlib.crc32(data[starts[i]:starts[i] + lengths[i]])
                out[i] = state if second is None else zlib.crc32(data[second[0][i]:second[0][i] + second[1][i]], zlib.crc32(b" ", state))
            continue
        column, at, size = np.arange(length), starts[of][:, None], lengths[of][:, None]
        if second is None:
            matrix = data[at + column]
        else:
            matrix = data[np.where(column < size, at + column, second[0][of][:, None] + np.maximum(column - size - 1, 0))]
            np.put_along_axis(matrix, size, 0x20, axis=1)
        out[of] = matrix_crcs(matrix)
    return out


def feature_buckets(column: pa.Array, segment: int = SEGMENT) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets of every row's words and of its pairs of words, in the order of the text: two lists of
    (places, offsets of rows). Texts are read in segments; a pair may reach from one into the next."""
    data, offsets = text_bytes(column)
    singles, pairs = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint16)]
    single_rows, pair_rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    before = None  # where the last word so far begins, its length and row
    for start, end in cut_segments(data, offsets, IS_WORD, segment):
        word = IS_WORD[data[start:end]]
        starts = word_starts(word, start, offsets)
        if not len(starts):
            continue
        lengths = np.add.reduceat(word.view(np.int8), starts, dtype=np.int64)
        starts = starts + start
        rows = np.searchsorted(offsets, starts, "right") - 1
        fresh = 0
        base = start
        if before is not None and before[2] == rows[0]:
            starts, lengths, rows = (np.concatenate([[b], x]) for b, x in zip(before, (starts, lengths, rows)))
            fresh, base = 1, int(starts[0])  # only as the first half of a pair
        before = int(starts[-1]), int(lengths[-1]), int(rows[-1])
        lowered, at = LOWER[data[base:end]], starts - base
        ids, places = _words(lowered, at, lengths)
        of_words = (_crcs(lowered, (at[places], lengths[places])) % BUCKETS).astype(np.uint16)
        singles.append(of_words[ids[fresh:]])
        single_rows.append(rows[fresh:])
        both = np.flatnonzero(rows[1:] == rows[:-1])
        if len(both):
            named, inverse = np.unique(ids[both] * len(places) + ids[both + 1], return_inverse=True)
            a, b = places[named // len(places)], places[named % len(places)]
            of_pairs = (_crcs(lowered, (at[a], lengths[a]), (at[b], lengths[b])) % BUCKETS).astype(np.uint16)
            pairs.append(of_pairs[inverse])
            pair_rows.append(rows[both + 1])
    edges = np.arange(len(offsets))
    return [[np.concatenate(found), np.searchsorted(np.concatenate(owners), edges)] for found, owners in ((singles, single_rows), (pairs, pair_rows))]


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer((offsets * 2).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values, "<u2").tobytes())]).cast(pa.binary())


def hashed(docs: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns, ``words`` (their number), and ``singles`` and ``pairs``: buckets, two bytes each."""

    def run(batches):
        for batch in slices(batches, "_text"):
            (singles, of_singles), (pairs, of_pairs) = feature_buckets(batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(np.diff(of_singles)), _binary(singles, of_singles), _binary(pairs, of_pairs)],
                [*keep, "words", "singles", "pairs"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema + "words long, singles binary, pairs binary")


def bucket_counts(features: DataFrame) -> np.ndarray:
    """How many features of all rows fall into each bucket."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for name in ("singles", "pairs"):
                counts += np.bincount(text_bytes(batch.column(name))[0].view("<u2"), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "times"])

    counted = features.select("singles", "pairs").mapInArrow(run, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, times in counted.collect():  # BUCKETS rows at most
        out[bucket] = times
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much more often the target has each bucket."""
    total, total_target = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(t) + 1) * total / ((float(s) + 1) * total_target))) for s, t in zip(corpus, target)], np.int64)


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel number that the id and the seed fix."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` (of those drawn, else null).

    ``target`` has a column ``text``. Of the documents of ``least_words`` words or more, ``percent`` in
    a hundred are drawn, rounded down, those of the highest scores first, ties by smaller id.

    * Null, empty and wordless texts have no features and weight 0; they count in no bucket and are not drawn.
    * Repeated rows are documents of their own with the same score; null ids take the number of an empty id, last among ties.
    * Without target texts every bucket's gain is what the corpus alone gives. An empty table gives an empty result.
    * Whole texts are read, whatever their length. Other columns are not read, whatever their names.
    """
    made = written(hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), "feature-buckets")
    value = gains(bucket_counts(made), bucket_counts(hashed(target)))
    shared = docs.sparkSession.sparkContext.broadcast(value)  # BUCKETS numbers

    def run(batches):
        for batch in batches:
            total = np.zeros(batch.num_rows, np.int64)
            n = np.zeros(batch.num_rows, np.int64)
            for name in ("singles", "pairs"):
                raw, offsets = text_bytes(batch.column(name))
                running = np.concatenate([[0], np.cumsum(shared.value[raw.view("<u2")])])
                total += running[offsets[1:] // 2] - running[offsets[:-1] // 2]
                n += np.diff(offsets) // 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("words"), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "words", "n_features", "weight"])

    weighed = made.mapInArrow(run, "doc_id long, words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    able = F.col("words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    order = [F.desc("score"), F.col("doc_id").isNull(), F.col("doc_id")]
    placed = ranked(scored.where(able), order, position="rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return placed.select(*columns).unionByName(rest.select(*columns))


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The documents drawn, with all their columns, in no order.

    See ``resampled``. Of rows that repeat an id all stay if one of them is drawn, and rows of null ids likewise.
    """
    found = resampled(docs, target, **settings).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_drawn"]), "left_semi")


@query()
def op13_target_resampling(spark, folder):
    return resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
