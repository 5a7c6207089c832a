"""Quality by a byte-level convolutional network in numpy.

Every byte of a text has a learned vector of WIDTH numbers. FILTERS learned filters look at REACH
neighbouring bytes each, at every place of the whole text. A chunk is two neighbouring stretches of
STRETCH places, and chunks overlap by one stretch, so that each place but those at the ends is in
two of them. A filter's highest answer in a chunk goes through a small layer of HIDDEN units; the
highest and the mean value of each unit over all chunks give one probability.

The network is fitted on at most TRAIN_ROWS labelled documents, chosen by hash. These are dealt into
SHARDS, each of which runs Adam over its own documents in a task of its own; after each round the
driver averages the numbers fitted, weighted by documents. Texts stay where Spark puts them: the
driver sees some thousand numbers a shard. Batches are made by hash order, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loggrove.llm.registry import query, table
from loggrove.llm.textcols import slices, text_bytes
from loggrove.llm.toxicity import held_out
from loggrove.scratch import written

TRAIN_ROWS = 4_000  # labelled documents the network is fitted on at most
WIDTH, REACH, FILTERS, STRETCH, HIDDEN = 8, 6, 24, 256, 16
SHARDS, ROUNDS, BATCH, STEP, SHRINK, SEED = 4, 12, 4, 1.2e-2, 1e-5, 5
KEPT = 0.3  # the score from which a document is predicted good
LEAK = 0.1  # what a unit of the small layer passes on of values below zero
SLAB = 32  # stretches that are worked on at a time

_SHAPES = {"bytes": (256, WIDTH), "filters": (REACH * WIDTH, FILTERS), "shift": (FILTERS,), "inner": (FILTERS, HIDDEN),
           "inner_shift": (HIDDEN,), "outer": (2 * HIDDEN,), "bias": (1,)}


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The network's arrays as views of one vector of all its numbers."""
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at:at + size].reshape(shape)
        at += size
    return out


def fresh(share: float) -> np.ndarray:
    """Random numbers to begin with; ``share`` is that of good documents."""
    random = np.random.default_rng(SEED)
    flat = np.zeros(sum(int(np.prod(s)) for s in _SHAPES.values()), np.float32)
    net = parts(flat)
    for name, scale in (("bytes", 0.5), ("filters", 1 / np.sqrt(REACH * WIDTH)), ("inner", 1 / np.sqrt(FILTERS)), ("outer", 0.1)):
        net[name][:] = random.normal(0, scale, net[name].shape)
    net["bias"][:] = np.log(share / (1 - share))
    return flat


def laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with each text filled up with zeros to whole stretches, one at least, and the first stretch of each text."""
    lengths = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(np.maximum(-(-lengths // STRETCH), 1))])
    out = np.zeros(int(starts[-1]) * STRETCH, np.uint8)
    out[np.arange(len(data)) + np.repeat(starts[:-1] * STRETCH - offsets[:-1], lengths)] = data
    return out, starts


def _stretches(padded: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The bytes that filters see from the places of some stretches; none of the next text at a text's end."""
    whole = np.concatenate([padded[int(which[0]) * STRETCH:(int(which[-1]) + 1) * STRETCH + REACH - 1], np.zeros(REACH - 1, np.uint8)])
    rows = np.lib.stride_tricks.as_strided(whole, (len(which), STRETCH + REACH - 1), (STRETCH, 1)).copy()
    rows[np.isin(which + 1, starts), STRETCH:] = 0
    return rows


def pooled(net: dict, padded: np.ndarray, starts: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's highest answer in each stretch, and where it was if asked."""
    total = len(padded) // STRETCH
    high, at = np.empty((total, FILTERS), np.float32), np.empty((total, FILTERS), np.int64) if places else None
    for first in range(0, total, SLAB):
        which = np.arange(first, min(first + SLAB, total))
        seen = net["bytes"][_stretches(padded, starts, which)]
        windows = np.lib.stride_tricks.as_strided(seen, (len(which), STRETCH, REACH * WIDTH), (seen.strides[0], seen.strides[1], seen.strides[2]))
        answers = (windows.reshape(-1, REACH * WIDTH) @ net["filters"]).reshape(len(which), STRETCH, FILTERS)
        if places:
            at[which] = answers.argmax(axis=1)
            high[which] = np.take_along_axis(answers, at[which][:, None], axis=1)[:, 0]
        else:
            high[which] = answers.max(axis=1)
    return high + net["shift"], at


def _chunks(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second stretch of every chunk, and the first chunk of each text; a text of one stretch has one chunk of it alone."""
    n = np.maximum(np.diff(starts) - 1, 1)
    begins = np.concatenate([[0], np.cumsum(n)])
    left = np.arange(begins[-1]) + np.repeat(starts[:-1] - begins[:-1], n)
    right = np.minimum(left + 1, np.repeat(starts[1:] - 1, n))
    return left, right, begins


def _forward(net: dict, high: np.ndarray, starts: np.ndarray) -> tuple:
    left, right, begins = _chunks(starts)
    seen = np.maximum(np.maximum(high[left], high[right]), 0)
    hidden = seen @ net["inner"] + net["inner_shift"]
    hidden = np.maximum(hidden, np.float32(LEAK) * hidden)
    n = np.diff(begins)[:, None]
    top, mean = np.maximum.reduceat(hidden, begins[:-1]), np.add.reduceat(hidden, begins[:-1]) / n
    both = np.concatenate([top, mean], axis=1)
    return left, right, begins, seen, hidden, both, both @ net["outer"] + net["bias"][0]


def probabilities(flat: np.ndarray, column: pa.Array) -> np.ndarray:
    """The network's probability for every text of a column."""
    net = parts(flat)
    if not len(column):
        return np.zeros(0)
    padded, starts = laid_out(*text_bytes(column))
    raw = _forward(net, pooled(net, padded, starts)[0], starts)[-1]
    return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def gradient(flat: np.ndarray, padded: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """The gradient of the mean logistic loss over some texts, and the loss."""
    net, out = parts(flat), np.zeros_like(flat)
    of = parts(out)
    high, at = pooled(net, padded, starts, places=True)
    left, right, begins, seen, hidden, both, raw = _forward(net, high, starts)
    chance = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
    error = ((chance - labels) / len(labels)).astype(np.float32)
    of["outer"][:] = error @ both
    of["bias"][:] = error.sum()
    n = np.diff(begins)
    owner = np.repeat(np.arange(len(n)), n)
    # The highest value passes its share on to the first chunk that has it, the mean to all.
    pull = error[owner][:, None] * net["outer"][HIDDEN:] / n[owner][:, None]
    is_top = hidden == both[owner, :HIDDEN]
    before = np.cumsum(is_top, axis=0) - is_top
    pull += np.where(is_top & (before == before[begins[:-1]][owner]), error[owner][:, None] * net["outer"][:HIDDEN], 0)
    pull *= np.where(hidden > 0, np.float32(1), np.float32(LEAK))
    of["inner"][:] = seen.T @ pull
    of["inner_shift"][:] = pull.sum(axis=0)
    pull = (pull @ net["inner"].T) * (seen > 0)
    second = high[right] > high[left]
    to_high = np.zeros_like(high)
    np.add.at(to_high, left, np.where(second, 0, pull))
    np.add.at(to_high, right, np.where(second, pull, 0))
    of["shift"][:] = to_high.sum(axis=0)
    stretch, which = np.nonzero(to_high)
    amount = to_high[stretch, which]
    read = _stretches(padded, starts, np.arange(len(padded) // STRETCH))[stretch[:, None], at[stretch, which][:, None] + np.arange(REACH)]
    vectors = net["bytes"][read].reshape(len(stretch), REACH * WIDTH) * amount[:, None]
    for f in range(FILTERS):
        of["filters"][:, f] = vectors[which == f].sum(axis=0)
    back = (net["filters"].T[which] * amount[:, None]).reshape(-1, WIDTH)
    for d in range(WIDTH):
        of["bytes"][:, d] = np.bincount(read.ravel(), back[:, d], 256)
    loss = -np.mean(np.where(labels > 0, np.log(np.maximum(chance, 1e-9)), np.log(np.maximum(1 - chance, 1e-9))))
    return out, float(loss)


def trained(flat: np.ndarray, column: pa.Array, labels: np.ndarray, seed: int, step: float) -> np.ndarray:
    """The numbers after one pass of Adam over some texts in random batches."""
    data, offsets = text_bytes(column)
    order = np.random.default_rng(seed).permutation(len(labels))
    flat, slope, bend = flat.copy(), np.zeros_like(flat), np.zeros_like(flat)
    for turn, first in enumerate(range(0, len(order), BATCH), 1):
        chosen = order[first:first + BATCH]
        texts = [data[offsets[i]:offsets[i + 1]] for i in chosen]
        padded, starts = laid_out(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        pull = gradient(flat, padded, starts, labels[chosen].astype(np.float32))[0] + np.float32(SHRINK) * flat
        pull *= np.float32(min(1.0, 1.0 / (np.linalg.norm(pull) + 1e-9)))  # one odd batch moves little
        slope += np.float32(0.1) * (pull - slope)
        bend += np.float32(0.01) * (pull ** 2 - bend)
        flat -= np.float32(step) * (slope / (1 - 0.9 ** turn)) / (np.sqrt(bend / (1 - 0.99 ** turn)) + np.float32(1e-6))
    return flat.astype(np.float32)


def _one_pass(shared, turn: int, step: float):
    """A function that trains on one shard's documents."""

    def run(key, rows):
        rows = rows.sort_by("doc_id")
        shard = key[0].as_py()
        text = pa.concat_arrays(rows["text"].chunks)
        out = trained(shared.value, text, rows["quality"].to_numpy(), 1000 * turn + shard, step)
        return pa.table({"shard": pa.array([shard], pa.int32()), "rows": pa.array([rows.num_rows], pa.int64()), "numbers": pa.array([out.tobytes()], pa.binary())})

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray | None:
    """The numbers fitted on at most ``rows`` labelled documents outside the held-out fold; None without labels."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` pairs of numbers.
    sample = docs.select(F.col("doc_id").alias("_id"), "text").join(
        F.broadcast(chosen.withColumnRenamed("doc_id", "_label_id")), F.col("_id") == F.col("_label_id"))
    # Rows that repeat an id count once.
    taken = sample.groupBy(F.col("_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"), F.min("text").alias("text"))
    dealt = written(taken.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(SHARDS)).cast("int")), "quality-sample")
    total, good = dealt.agg(F.count(F.lit(1)), F.sum("quality")).first()
    if not total:
        return None
    flat = fresh((good + 1) / (total + 2))
    if good in (0, total):
        return flat * np.concatenate([np.zeros(len(flat) - 1, np.float32), np.ones(1, np.float32)])
    spark = docs.sparkSession
    for turn in range(ROUNDS):
        step = STEP * (1 - turn / ROUNDS)
        shared = spark.sparkContext.broadcast(flat)
        found = sorted(dealt.groupBy("shard").applyInArrow(_one_pass(shared, turn, step), "shard int, rows long, numbers binary").collect())  # SHARDS rows
        flat = (sum(n * np.frombuffer(x, np.float32).astype(np.float64) for _, n, x in found) / total).astype(np.float32)
        shared.unpersist()
    return flat


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score`` (0 to 1, higher is better) and ``predicted`` (1 from KEPT on).

    Labels are learned only from documents whose crc32 of the id as text is no multiple of 5.

    * Null and empty texts get the score of one stretch of zeros. Whole texts are read, whatever their length.
    * A null id is not held out, and has no label. Labels that repeat an id count as bad if one is.
    * With labels of one kind alone every document has the share of good labels as its score, a half without any.
    * Repeated rows are scored alike. An empty table gives none. Other columns are not read.
    """
    flat = fit(docs, labels, rows)
    if flat is None:
        flat = np.zeros_like(fresh(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(flat)

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probabilities(shared.value, batch.column("text")))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEPT).cast("int").alias("predicted"))


@query()
def op11_quality(spark, folder):
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
