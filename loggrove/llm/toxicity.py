"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words (letters and digits, A-Z lower-cased) and their
beginnings of three, four and five bytes, hashed to 2^20 places. A term's linear weight and its
vector of FACTORS numbers are fitted together; the products of two terms' vectors add what the
pair means together, as an insult beside the mention of a group does. Linear weights alone
can't tell.

The machine is fitted on at most TRAIN_ROWS labelled documents, chosen by hash. A term takes part
if its documents are toxic more or less often than chance allows (log-likelihood ratio of at
least TELLING), among all of them or among those that hold a term found so: the second kind are
terms that matter beside others only. AdaGrad fits their numbers. Scores are computed where the
documents are; only the fitted numbers are sent to the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loggrove.llm.registry import query, table
from loggrove.llm.textcols import LOWER, _table, cut_segments, hash_runs, slices, splitmix, text_bytes, word_starts
from loggrove.scratch import written

TRAIN_ROWS = 20_000  # labelled documents the machine is fitted on at most
PLACES = 1 << 20
BEGINNINGS = (3, 4, 5)
TELLING = 30.0
FACTORS = 4
EPOCHS, BATCH, STEP, SHRINK, SEED = 24, 32, 0.4, 3e-4, 11

_LETTERS = _table(bytes(range(128, 256)) + b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'")


def terms(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of each row's terms (of the ``wanted`` ones), and each row's offset in them."""
    data, offsets = text_bytes(column)
    found = [np.zeros(0, np.int64)]
    for start, end in cut_segments(data, offsets, _LETTERS):
        word = _LETTERS[data[start:end]]
        starts = word_starts(word, start, offsets)
        if not len(starts):
            continue
        lowered = LOWER[data[start:end]]
        lengths = np.add.reduceat(word.view(np.int8), starts, dtype=np.int32)
        rows = (np.searchsorted(offsets, starts + start, "right") - 1) << 20
        kinds = [(rows, hash_runs(lowered, word, starts))]
        for size in BEGINNINGS:
            longer = lengths >= size
            at, packed = starts[longer], np.full(int(longer.sum()), np.uint64(size))
            for i in range(size):
                packed = packed << np.uint64(8) | lowered[at + i]
            kinds.append((rows[longer], splitmix(packed)))
        for row, hashed in kinds:
            places = (hashed >> np.uint64(44)).astype(np.int64)
            if wanted is not None:
                kept = wanted[places]
                row, places = row[kept], places[kept]
            found.append(np.unique(row | places))
    keys = np.unique(np.concatenate(found))
    return keys & (PLACES - 1), np.searchsorted(keys >> 20, np.arange(len(offsets)))


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, values, n).astype(float)  # without any index the counts would be integers


class Machine:
    """Fitted numbers: ``linear`` and ``factors`` of the ``known`` places, in their order."""

    def __init__(self, bias: float, known: np.ndarray, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.known, self.linear, self.factors = bias, known, linear, factors
        self.wanted = np.zeros(PLACES, bool)
        self.wanted[known] = True

    def numbers(self) -> tuple:
        return self.bias, self.known, self.linear, self.factors

    def raw(self, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        rows, at = np.repeat(np.arange(n), np.diff(offsets)), np.searchsorted(self.known, places)
        out = self.bias + _sums(rows, self.linear[at], n)
        for v in self.factors.T:
            out += 0.5 * (_sums(rows, v[at], n) ** 2 - _sums(rows, v[at] ** 2, n))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*terms(column, self.wanted)), -30, 30)))


def _telling(sample: DataFrame) -> np.ndarray:
    """Places whose documents' labels differ from the others' by more than chance allows."""
    rows, toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not rows or toxic in (0, rows):
        return np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            lists = batch.column("places")
            places = lists.flatten().to_numpy()
            owners = np.repeat(batch.column("toxic").to_numpy(), np.diff(lists.offsets.to_numpy()))
            distinct, inverse = np.unique(places, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.astype(np.int32)), pa.array(np.bincount(inverse, minlength=len(distinct))),
                 pa.array(np.bincount(inverse[owners > 0], minlength=len(distinct)))], ["place", "seen", "toxic"])

    counted = sample.select("toxic", "places").mapInArrow(run, "place int, seen long, toxic long").groupBy("place").agg(
        F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    share = toxic / rows
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    clean = F.col("seen") - F.col("toxic")
    ratio = 2 * (part(F.col("toxic"), F.col("seen") * share) + part(clean, F.col("seen") * (1 - share)))
    return np.array(sorted(r["place"] for r in counted.where(ratio >= TELLING).select("place").collect()), np.int64)  # of 2^20 places


def _only(sample: DataFrame, known: np.ndarray) -> DataFrame:
    """The documents of ``sample`` with those of their places that are ``known``."""

    def run(batches):
        for batch in batches:
            lists = batch.column("places")
            places = lists.flatten().to_numpy()
            kept = np.isin(places, known)
            offsets = np.concatenate([[0], np.cumsum(kept)])[lists.offsets.to_numpy()]
            own = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places[kept], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), own], ["doc_id", "toxic", "places"])

    return sample.mapInArrow(run, "doc_id long, toxic int, places array<int>")


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, known: np.ndarray) -> Machine:
    """AdaGrad on the logistic loss of a bounded list of documents' known places."""
    random = np.random.default_rng(SEED)
    share = (labels.sum() + 1) / (len(labels) + 2)
    fitted = Machine(float(np.log(share / (1 - share))), known, np.zeros(len(known)), random.normal(0, 0.01, (len(known), FACTORS)))
    rows = [np.searchsorted(known, r) for r in rows]
    of_linear, of_factors, of_bias = np.ones(len(known)), np.ones((len(known), FACTORS)), 1.0
    for _ in range(EPOCHS if len(known) else 0):
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            sizes = [len(rows[i]) for i in chosen]
            places, owner = np.concatenate([rows[i] for i in chosen]), np.repeat(np.arange(len(chosen)), sizes)
            raw = fitted.raw(known[places], np.concatenate([[0], np.cumsum(sizes)]))
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]
            distinct, inverse = np.unique(places, return_inverse=True)
            v = fitted.factors[places]
            sums = np.stack([_sums(owner, v[:, f], len(chosen)) for f in range(FACTORS)], axis=1)
            pull = _sums(inverse, error[owner], len(distinct)) + SHRINK * fitted.linear[distinct]
            of_linear[distinct] += pull ** 2
            fitted.linear[distinct] -= STEP * pull / np.sqrt(of_linear[distinct])
            bend = np.stack([_sums(inverse, error[owner] * (sums[owner, f] - v[:, f]), len(distinct)) for f in range(FACTORS)], axis=1)
            bend += SHRINK * fitted.factors[distinct]
            of_factors[distinct] += bend ** 2
            fitted.factors[distinct] -= 0.1 * STEP * bend / np.sqrt(of_factors[distinct])
            of_bias += error.sum() ** 2
            fitted.bias -= STEP * error.sum() / np.sqrt(of_bias)
    return fitted


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on at most ``rows`` labelled documents outside the held-out fold."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` pairs of numbers.
    sample = docs.select(F.col("doc_id").alias("_id"), "text").join(
        F.broadcast(chosen.withColumnRenamed("doc_id", "_label_id")), F.col("_id") == F.col("_label_id"))

    def run(batches):
        for batch in slices(batches):
            places, offsets = terms(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), lists], ["doc_id", "toxic", "places"])

    sized = sample.select("_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, places array<int>")
    # Counted where it lies: only the places that tell something come to the driver.
    table_ = written(sized.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("places").alias("places")), "toxicity-sample")
    alone = _telling(table_)
    beside = _telling(table_.join(_only(table_, alone).where(F.size("places") > 0).select("doc_id"), "doc_id", "left_semi")) if len(alone) else alone
    known = np.union1d(alone, beside)
    # Sorted, so that reruns see one order.
    rows_ = _only(table_, known).toArrow().sort_by("doc_id")
    lists = [np.asarray(x.values, np.int64) for x in rows_["places"]]
    return fit_machine(lists, rows_["toxic"].to_numpy().astype(float), known)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxic_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Labels are learned only from documents whose crc32 of the id as text is no multiple of 5.

    * Null, empty and wordless texts get the score of no terms, the fitted bias.
    * A null id is not held out, and has no label. Labels that repeat an id count as toxic if one is.
    * Without labels of both kinds every document has the score of the share of toxic labels, a half without any.
    * Repeated rows are scored alike. An empty table gives none. Other columns are not read.
    """
    machine = fit(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast(machine.numbers())

    def run(batches):
        fitted = Machine(*shared.value)
        for batch in slices(batches):
            scores = fitted.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, whatever their names.

    Null, empty and wordless texts have the score of no terms; repeated rows are judged alike, and null ids like others.
    Where nothing was learned (no labels, labels of one kind, no telling term) all documents stay.
    """
    machine = fit(docs, labels, rows)
    if not len(machine.known):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(machine.numbers())

    def run(batches):
        fitted = Machine(*shared.value)
        for batch in slices(batches):
            scores = fitted.scores(batch.column(at))
            yield batch.filter(pa.array(scores < 0.5))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)


@query()
def op10_toxicity(spark, folder):
    return toxic_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
