"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash of GRAM bytes is taken at every byte of a text. Each string of LENGTH bytes has a
trigger, the smallest of the hashes inside it. A phrase is a stretch of neighbouring strings with
the same trigger, with all their bytes; so a phrase depends on nothing but its bytes, and
equal strings lie at the same place of phrases with equal triggers. The parse of a text is its
sequence of phrases, the dictionary holds the distinct ones.

1. A trigger that occurs once in the corpus has no repeated string. Only the others go on.
2. A phrase that occurs again is repeated as a whole: all its occurrences but the first in corpus
   order (id, place) are settled without a look at their bytes.
3. A trigger with several different phrases may have strings in common between them. Only there
   the suffixes of the dictionary's phrases, cut at LENGTH bytes, are named, sorted and grouped;
   the first of each group in corpus order stays. A trigger with very many different phrases is
   grouped suffix by suffix by partial aggregation, so that no task holds it whole.

Strings are named by 64-bit hashes of their bytes beside the 64-bit trigger. The bytes that
repeated strings cover are put together per document and cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loggrove.llm.registry import query, table
from loggrove.llm.shelf import Shelf
from loggrove.llm.textcols import SEGMENT, slices, splitmix, text_bytes

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # places of a trigger in a string
CROWDED = 10_000  # a trigger of more different phrases is grouped by partial aggregation
NO_ID = (1 << 63) - 1  # stands for a null id, last in corpus order

_BASE = 0x100000001B3


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM bytes."""
    hashed, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < GRAM:
        hashed = hashed[:-size] + np.uint64(pow(_BASE, size, 1 << 64)) * hashed[size:]
        size *= 2
    return splitmix(hashed)


def _sliding_minima(hashed: np.ndarray, span: int) -> np.ndarray:
    size = 1
    while size * 2 <= span:
        hashed, size = np.minimum(hashed[:-size], hashed[size:]), size * 2
    return np.minimum(hashed[:size - span], hashed[span - size:]) if size < span else hashed


def _string_names(hashed: np.ndarray, begins: np.ndarray, lengths) -> np.ndarray:
    """Names of byte strings, from the hashes of the grams that cover them."""
    names = np.zeros(len(begins), np.uint64)
    longest = int(np.max(lengths)) if len(begins) else 0
    last = begins + lengths - GRAM
    for at in range(0, max(longest - GRAM, 0) + GRAM, GRAM):
        names = splitmix(names * np.uint64(_BASE) + hashed[np.minimum(begins + at, last)])
    return splitmix(names + np.asarray(lengths).astype(np.uint64))


def phrases(data: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first string, number of strings, trigger, name) of a text's phrases.

    A long text is parsed in segments; phrases cut there differ from uncut ones and are then
    compared string by string.
    """
    parts = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]]
    for at in range(0, len(data) - LENGTH + 1, segment):
        hashed = gram_hashes(data[at:at + segment + LENGTH - 1])
        triggers = _sliding_minima(hashed, SPAN)
        begins = np.flatnonzero(np.concatenate([[True], triggers[1:] != triggers[:-1]]))
        counts = np.diff(np.append(begins, len(triggers)))
        # Where the trigger's gram itself repeats, as in runs of one letter, a phrase ends with each place of it.
        places = begins + (hashed[begins[:, None] + np.arange(SPAN)] == triggers[begins][:, None]).argmax(axis=1)
        again = np.flatnonzero(places < begins + counts - 1)
        if len(again):
            more = [np.zeros(0, np.int64)]
            for i in again:
                first, end = int(begins[i]), int(begins[i] + counts[i])
                same = first + np.flatnonzero(hashed[first:end + SPAN - 1] == triggers[first])
                more.append(same[same < end - 1] + 1)
            begins = np.union1d(begins, np.concatenate(more))
            counts = np.diff(np.append(begins, len(triggers)))
        # A phrase may be long at a segment's end only through equal grams, which the line above has cut.
        names = _string_names(hashed, begins, counts + LENGTH - 1)
        parts.append([begins + at, counts, triggers[begins], names])
    return tuple(np.concatenate(x) for x in zip(*parts))


def _parsed(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            found = [phrases(data[offsets[i]:offsets[i + 1]]) for i in range(len(offsets) - 1)]
            rows = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            place, count, trigger, name = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(rows)), batch.column("version").take(pa.array(rows)), pa.array(place.astype(np.int32)),
                 pa.array(count.astype(np.int32)), pa.array(trigger.view(np.int64)), pa.array(name.view(np.int64))],
                ["doc", "version", "place", "strings", "trigger", "name"])

    return docs.select("doc", "version", "text").mapInArrow(run, "doc long, version long, place int, strings int, trigger long, name long")


def _phrase_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` phrases (doc, version, place, strings, trigger) with their bytes."""
    # A document's phrases together are about as large as its text.
    lists = wanted.groupBy("doc", "version").agg(F.collect_list(F.struct("place", "strings", "trigger")).alias("wanted"))

    def run(batches):
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            lists = batch.column("wanted")
            sizes = np.diff(lists.offsets.to_numpy())
            place, strings, trigger = (x.to_numpy().astype(np.int64) for x in lists.flatten().flatten())
            rows = np.repeat(np.arange(len(sizes)), sizes)
            lengths = strings + LENGTH - 1
            ends = np.cumsum(lengths)
            at = np.repeat(offsets[rows] + place - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
            bytes_ = pa.Array.from_buffers(pa.binary(), len(rows), [
                None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(rows)), batch.column("version").take(pa.array(rows)), pa.array(place.astype(np.int32)),
                 pa.array(strings.astype(np.int32)), pa.array(trigger), bytes_], ["doc", "version", "place", "strings", "trigger", "bytes"])

    # Equal rows of one id give equal phrases at equal places, which remove neither.
    return docs.select("doc", "version", "text").join(lists, ["doc", "version"]).select("doc", "version", "text", "wanted").mapInArrow(
        run, "doc long, version long, place int, strings int, trigger long, bytes binary")


def _suffixes(column: pa.Array, strings: np.ndarray, trigger: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the phrase, name) of all strings of LENGTH bytes in a column of phrases."""
    data, offsets = text_bytes(column)
    rows = np.repeat(np.arange(len(strings)), strings)
    ends = np.cumsum(strings)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - strings, strings)
    if not len(rows):
        return rows, inside, np.zeros(0, np.uint64)
    names = _string_names(gram_hashes(data), offsets[rows] + inside, np.full(len(rows), LENGTH))
    return rows, inside, splitmix(names ^ trigger.view(np.uint64)[rows])


def _shared_strings(stretches: DataFrame) -> DataFrame:
    """Repeated strings among different phrases of one trigger, as stretches (doc, version, place, strings)."""

    def resolve(batch: pa.RecordBatch):
        doc, version, place, strings = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "version", "place", "strings"))
        rows, inside, names = _suffixes(batch.column("bytes"), strings, batch.column("trigger").to_numpy())
        order = np.argsort(names, kind="stable")  # rows come in corpus order, so equal strings stay in it
        fresh = np.concatenate([[True], names[order][1:] != names[order][:-1]])
        first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        at = place[rows] + inside
        repeated = np.zeros(len(rows), bool)
        repeated[order] = (doc[rows[order]] != doc[rows[first]]) | (at[order] != at[first])
        begins = np.flatnonzero(repeated & np.concatenate([[True], ~repeated[:-1] | (rows[1:] != rows[:-1])]))
        ends = np.flatnonzero(repeated & np.concatenate([~repeated[1:] | (rows[1:] != rows[:-1]), [True]]))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[rows[begins]]), pa.array(version[rows[begins]]), pa.array(at[begins].astype(np.int32)),
             pa.array((ends - begins + 1).astype(np.int32))], ["doc", "version", "place", "strings"])

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            trigger = joined.column("trigger").to_numpy()
            last = int(np.searchsorted(trigger, trigger[-1]))  # the last trigger may go on in the next batch
            kept = joined.slice(last)
            if last:
                yield resolve(joined.slice(0, last))
        if kept is not None:
            yield resolve(kept)

    ordered = stretches.repartition("trigger").sortWithinPartitions("trigger", "doc", "place", "version")
    return ordered.select("doc", "version", "place", "strings", "trigger", "bytes").mapInArrow(
        run, "doc long, version long, place int, strings int")


def _shared_in_crowds(stretches: DataFrame) -> DataFrame:
    """The same for triggers of very many phrases, a row per string."""

    def run(batches):
        for batch in batches:
            strings = batch.column("strings").to_numpy().astype(np.int64)
            rows, inside, names = _suffixes(batch.column("bytes"), strings, batch.column("trigger").to_numpy())
            at = batch.column("place").to_numpy().astype(np.int64)[rows] + inside
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(taken), batch.column("version").take(taken), pa.array(at.astype(np.int32)),
                 batch.column("trigger").take(taken), pa.array(names.view(np.int64))], ["doc", "version", "place", "trigger", "string"])

    one = stretches.select("doc", "version", "place", "strings", "trigger", "bytes").mapInArrow(
        run, "doc long, version long, place int, trigger long, string long")
    first = one.groupBy("trigger", "string").agg(F.min(F.struct("doc", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return one.join(first, ["trigger", "string"]).where("doc <> first.doc OR place <> first.place").select(
        "doc", "version", "place", F.lit(1).alias("strings"))


def _cut(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """Per row what is left after removing the stretches of its document."""
    lists = stretches.groupBy("doc", "version").agg(F.collect_list(F.struct("place", "strings")).alias("stretches"))

    def run(batches):
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            lists = batch.column("stretches")
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
            flat = lists.flatten()
            place, strings = (x.to_numpy().astype(np.int64) for x in flat.flatten())
            ends = np.cumsum(sizes)
            removed, spans, digests = [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i]:offsets[i + 1]]
                if not sizes[i]:
                    removed.append(0)
                    spans.append(0)
                    digests.append(hashlib.sha256(text.tobytes()).hexdigest())
                    continue
                own = slice(ends[i] - sizes[i], ends[i])
                order = np.argsort(place[own], kind="stable")
                begin = place[own][order]
                end = np.maximum.accumulate(begin + strings[own][order] + LENGTH - 1)
                gap = np.concatenate([[True], begin[1:] > end[:-1]])
                begin, end = begin[gap], end[np.append(np.flatnonzero(gap)[1:] - 1, len(gap) - 1)]
                digest, at = hashlib.sha256(), 0
                for b, e in zip(begin.tolist(), end.tolist()):
                    digest.update(text[at:b].tobytes())
                    at = e
                digest.update(text[at:].tobytes())
                removed.append(int((end - begin).sum()))
                spans.append(len(begin))
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = docs.join(lists, ["doc", "version"], "left").select(
        "doc_id", "text", F.coalesce("stretches", F.array().cast("array<struct<place:int,strings:int>>")).alias("stretches"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` after removing
    every byte covered by a string of 100 bytes that also starts earlier in the corpus.

    Earlier means in a document of smaller id, or in the same document at a smaller place.

    * Null texts count as empty; texts under 100 bytes lose nothing. Matches never cross documents.
    * Rows that repeat an id count as one document's: of two such rows the string at the smaller
      place is the earlier one, and strings at the same place remove neither. Null ids come last.
    * Very long texts are parsed in segments. An empty table gives none. Other columns are not read.
    """
    shelf = Shelf(docs.sparkSession)
    source = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                         F.xxhash64("text").alias("version"), F.coalesce("text", F.lit("")).alias("text"))
    parse = shelf.put(_parsed(source), "parse")
    again = shelf.put(parse.groupBy("trigger").count().where("count > 1").select("trigger"), "triggers")
    shelf.drop()
    occurring = shelf.put(parse.join(again, "trigger", "left_semi"), "occurring")
    shelf.drop("parse", "triggers")
    dictionary = shelf.put(occurring.groupBy("trigger", "name").agg(
        F.min(F.struct("doc", "place", "version", "strings")).alias("first"), F.count(F.lit(1)).alias("n")), "dictionary")
    repeated = dictionary.where("n > 1").select("trigger", "name", "first")
    whole = occurring.join(repeated, ["trigger", "name"]).where("doc <> first.doc OR place <> first.place")
    whole = shelf.put(whole.select("doc", "version", "place", "strings"), "whole")

    kinds = shelf.put(dictionary.groupBy("trigger").agg(F.count(F.lit(1)).alias("names")).where("names > 1"), "kinds")
    mixed = dictionary.join(kinds, "trigger").select("first.*", "trigger", "names")
    crowds = kinds.where(F.col("names") > crowded).select("trigger")
    stretches = shelf.put(_phrase_bytes(source, mixed), "stretches")
    shelf.drop("occurring", "dictionary")
    if crowds.isEmpty():
        shared = _shared_strings(stretches)
    else:
        shared = _shared_strings(stretches.join(crowds, "trigger", "left_anti")).union(
            _shared_in_crowds(stretches.join(crowds, "trigger", "left_semi")))
    found = shelf.put(whole.union(shared), "repeats")
    shelf.drop("whole", "stretches", "kinds")
    return _cut(source, found)


@query()
def op7_repeated_strings(spark, folder):
    return without_repeats(table(spark, folder, "documents"))
