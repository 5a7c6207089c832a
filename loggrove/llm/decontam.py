"""Benchmark passages in documents, also with other numbers, names and units.

Texts become templates: numbers, capitalised words (a run of them is one name) and units after a
number are replaced by typed placeholders, whose words are kept aside as slot values. Windows of
five template words of the benchmark items are looked up in the windows of every document. A
document is reported for an item if at least 0.8 of the item's windows lie along one line in it
(the document place less the item place is about the same), and the slots agree: wherever the item
repeats a number or name, the document must repeat what stands there, and different ones must stay
different. A window with fewer than two ordinary words is compared as written.

Capitals decide what is a name, so windows of five lower-cased words as written are looked up as
well: a document is also reported if 0.8 of those lie along one line, whatever its capitals.

The benchmark is taken in blocks of a bounded number of windows; each block is sent to the tasks
and all documents are read against it. A document's matches are settled where it is read.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loggrove.llm.registry import query, table
from loggrove.llm.textcols import LOWER, _table, cut_segments, hash_runs, shingle_hashes, slices, splitmix, text_bytes

WINDOW, SIMILARITY, CONSISTENCY, LEAST_WORDS = 5, 0.8, 0.8, 2
BLOCK_WINDOWS = 1_000_000  # windows of benchmark items that are sent to the tasks at a time

# Units that become placeholders after a number.
UNITS = ("mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds "
         "ton tons tonne tonnes ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours h day days week weeks "
         "month months year years dollar dollars cent cents euro euros usd eur percent mph kmh volt volts watt watts degree degrees")

_DIGIT = _table(b"0123456789")
_WORD = _table(bytes(range(128, 256)) + b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'")
_UPPER = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_POINT = _table(b".,")
_STOP = _table(b".!?;:\n")
_UNCUT = _WORD | _POINT
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
_HOLDERS = splitmix(np.arange(4, dtype=np.uint64) + np.uint64(77))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lower-cased words and numbers, their kinds, whether a stop stands before, and each row's offset in them."""
    data, offsets = text_bytes(column)
    hashes, kinds, stopped, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
    for start, end in cut_segments(data, offsets, _UNCUT):
        piece = data[start:end]
        edges = offsets[np.searchsorted(offsets, start):np.searchsorted(offsets, end)] - start
        digit, word = _DIGIT[piece], _WORD[piece]
        inner = _POINT[piece]  # a point or comma between digits belongs to the number
        inner[:1] = inner[-1:] = False
        inner[1:-1] &= digit[:-2] & digit[2:]
        inner[edges] = False
        inner[edges[edges > 0] - 1] = False
        digit, word = digit | inner, word | inner
        begins = word.copy()
        begins[1:] &= ~(word[:-1] & (digit[1:] == digit[:-1]))
        begins[edges] = word[edges]
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        lowered = LOWER[piece]
        latin = np.zeros(len(piece), bool)  # second bytes of the capitals from U+00C0 to U+00DE
        latin[1:] = (piece[:-1] == 0xC3) & (piece[1:] >= 0x80) & (piece[1:] <= 0x9E)
        lowered[latin] += 0x20
        lengths = np.add.reduceat(word.view(np.int8), starts, dtype=np.int32)
        wide = np.append(latin[1:], False)[starts]
        second = np.minimum(starts + 1 + wide, len(piece) - 1)
        capital = (_UPPER[piece[starts]] | wide) & (lengths > 1 + wide) & ~_UPPER[piece[second]] & ~np.append(latin[1:], False)[second]
        stops = np.cumsum(_STOP[piece] & ~inner)[starts]
        stopped.append(np.concatenate([[True], stops[1:] != stops[:-1]]))
        hashes.append(hash_runs(lowered, word, starts))
        kinds.append(np.where(digit[starts], NUMBER, np.where(capital, NAME, PLAIN)).astype(np.int8))
        places.append(starts + start)
    return np.concatenate(hashes), np.concatenate(kinds), np.concatenate(stopped), np.searchsorted(np.concatenate(places), offsets)


_UNIT_HASHES = np.sort(_tokens(pa.array([UNITS]))[0])


def templates(values: np.ndarray, kinds: np.ndarray, stopped: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template words of tokens, the words that stand there, their kinds, and each row's offset."""
    first = np.zeros(len(values) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    before = np.concatenate([[PLAIN], kinds[:-1]]) if len(kinds) else kinds
    after_number = (before == NUMBER) & ~first & (kinds == PLAIN)
    kinds[after_number & np.isin(values, _UNIT_HASHES)] = UNIT
    kept = ~((kinds == NAME) & (before == NAME) & ~first & ~stopped)
    # Of a run of capitalised words the last one names it; the first may only begin a sentence.
    values = values[np.append(np.flatnonzero(kept)[1:] - 1, len(values) - 1)] if len(values) else values
    offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
    kinds = kinds[kept]
    return np.where(kinds == PLAIN, values, _HOLDERS[kinds]), values, kinds, offsets


def windows(template: np.ndarray, values: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of five, and each row's offset in them; a shorter row is one window."""
    hashed, places = shingle_hashes(template, offsets, WINDOW)
    written, _ = shingle_hashes(splitmix(values), offsets, WINDOW)
    plain = np.concatenate([[0], np.cumsum(kinds == PLAIN)])
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(places))
    begin = offsets[rows] + np.arange(len(hashed)) - places[rows]
    few = plain[np.minimum(begin + WINDOW, offsets[rows + 1])] - plain[begin] < LEAST_WORDS
    return np.where(few, written, hashed), places


class Index:
    """Windows of some items, sorted by their hashes."""

    def __init__(self, hashed: np.ndarray, places: np.ndarray):
        order = np.argsort(hashed, kind="stable")
        self.hashed = hashed[order]
        self.item = np.repeat(np.arange(len(places) - 1), np.diff(places))[order]
        self.at = order - places[self.item]
        self.sizes = np.diff(places)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.hashed >> np.uint64(42)] = True

    @classmethod
    def of(cls, arrays: dict) -> Index:
        index = cls.__new__(cls)
        index.__dict__.update(arrays)
        return index

    def matches(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window of the document, item, window of the item) of all equal pairs."""
        maybe = np.flatnonzero(self.seen[hashed >> np.uint64(42)])
        low, high = (np.searchsorted(self.hashed, hashed[maybe], side) for side in ("left", "right"))
        times = high - low
        window = np.repeat(maybe, times)
        found = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        return window, self.item[found], self.at[found]

    def lines(self, hashed: np.ndarray, places: np.ndarray):
        """(row, item, item windows found, line, their places in the item and in the row) of all lines that hold enough of an item."""
        window, item, at = self.matches(hashed)
        if not len(window):
            return
        row = np.searchsorted(places, window, "right") - 1
        here = window - places[row]
        order = np.lexsort((here, at, item, row))
        row, item, at, here = row[order], item[order], at[order], here[order]
        starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]))
        for begin, end in zip(starts, np.append(starts[1:], len(row))):
            r, i = int(row[begin]), int(item[begin])
            size = int(self.sizes[i])
            if len(np.unique(at[begin:end])) < SIMILARITY * size:
                continue
            lines, times = np.unique(here[begin:end] - at[begin:end], return_counts=True)
            # The line where most windows of the item lie, with room for words put in or left out.
            room = max(2, size // 4)
            for line in lines[np.argsort(-times, kind="stable")]:
                on = begin + np.flatnonzero(np.abs(here[begin:end] - at[begin:end] - line) <= room)
                distinct = len(np.unique(at[on]))
                if distinct >= SIMILARITY * size:
                    yield r, i, distinct, int(line), at[on], here[on]


class Block:
    """The windows and words of some benchmark items, as sorted arrays: as templates and as written."""

    def __init__(self, ids: list, column: pa.Array):
        tokens = _tokens(column)
        written, written_places = shingle_hashes(tokens[0], tokens[3], WINDOW)
        template, self.values, self.kinds, self.offsets = templates(*tokens)
        self.words = np.diff(tokens[3])
        self.ids, self.index, self.written = ids, vars(Index(*windows(template, self.values, self.kinds, self.offsets))), vars(Index(written, written_places))

    @classmethod
    def of(cls, arrays: dict) -> Block:
        """The block again from its arrays, which are what is sent to the tasks."""
        block = cls.__new__(cls)
        block.__dict__.update(arrays)
        return block

    def agreement(self, item: int, pairs: list[tuple[int, int]], line: int, values: np.ndarray, begin: int) -> tuple[int, float]:
        """Of windows paired along a line: how many slots of the item were met; and of those whose number or name repeats in the item, or whose name
        stands for several of the item's, the share that a one-to-one renaming explains (1 without such slots)."""
        own = int(self.offsets[item])
        end = int(self.offsets[item + 1]) - own
        met: dict[int, int] = {}  # each word has one partner, the one nearest to the line
        for q0, p0 in pairs:
            for q, p in zip(range(q0, min(q0 + WINDOW, end)), range(p0, p0 + WINDOW)):
                if self.kinds[own + q] != PLAIN and (q not in met or abs(p - q - line) < abs(met[q] - q - line)):
                    met[q] = p
        times: dict[tuple, int] = {}
        for q in range(end):
            key = (int(self.kinds[own + q]), int(self.values[own + q]))
            times[key] = times.get(key, 0) + 1
        votes: dict[tuple, int] = {}
        for q, p in met.items():
            key = (int(self.kinds[own + q]), int(self.values[own + q]), int(values[begin + p]))
            votes[key] = votes.get(key, 0) + 1
        here_for: dict[tuple, set] = {}
        for kind, value, here in votes:
            here_for.setdefault((kind, here), set()).add(value)
        asked = agreed = 0
        taken_item, taken_here = set(), set()
        for (kind, value, here), n in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
            # Two numbers may become equal; two names that become one are another text.
            fits = (kind, value) not in taken_item and not (kind == NAME and here in taken_here)
            if fits:
                taken_item.add((kind, value))
                taken_here |= {here} if kind == NAME else set()
            if kind != UNIT and times[kind, value] > 1 or kind == NAME and len(here_for[kind, here]) > 1:
                asked, agreed = asked + n, agreed + n * fits
        return len(met), agreed / asked if asked else 1.0


def _partners(at: np.ndarray, here: np.ndarray, line: int) -> list[tuple[int, int]]:
    """One place in the document for each window of an item: the nearest to the line, as far as these rise together."""
    order = np.lexsort((np.abs(here - at - line), at))
    at, here = at[order], here[order]
    nearest = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    at, here = at[nearest], here[nearest]
    ends, tails, before = [], [], np.full(len(at), -1)  # the longest rising run
    for i, place in enumerate(here.tolist()):
        k = bisect_left(ends, place)
        before[i] = tails[k - 1] if k else -1
        ends[k:k + 1], tails[k:k + 1] = [place], [i]
    kept, i = [], tails[-1]
    while i >= 0:
        kept.append((int(at[i]), int(here[i])))
        i = before[i]
    return kept[::-1]


def _found(block: Block, column: pa.Array) -> list[tuple]:
    """(row, item number, windows found, similarity, slots, agreement) of what is reported."""
    tokens = _tokens(column)
    written, written_places = shingle_hashes(tokens[0], tokens[3], WINDOW)
    template, values, kinds, offsets = templates(*tokens)
    index, out = Index.of(block.index), {}
    for r, i, distinct, line, at, here in index.lines(*windows(template, values, kinds, offsets)):
        if (r, i) not in out:
            slots, agreed = block.agreement(i, _partners(at, here, line), line, values, int(offsets[r]))
            if agreed >= CONSISTENCY:
                out[r, i] = (distinct, distinct / int(index.sizes[i]), slots, agreed)
    index = Index.of(block.written)
    for r, i, distinct, *_ in index.lines(written, written_places):
        # As written: the words of the windows found are the item's, and so are those in its slots.
        if block.words[i] >= WINDOW:
            out.setdefault((r, i), (distinct, distinct / int(index.sizes[i]), 0, 1.0))
    return [(*which, *rest) for which, rest in sorted(out.items())]


def _blocks(benchmark: DataFrame, limit: int):
    """The items in blocks of about ``limit`` windows, as arrays."""
    # A window needs a word, a word two bytes at least: the bytes bound the windows.
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / (2 * limit)))
    for i in range(n):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).select(F.col("item_id").cast("long"), "text").toArrow()
        if part.num_rows:
            yield Block(part["item_id"].to_pylist(), part["text"].combine_chunks())


def contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id``, ``item_id``, ``windows`` (found),
    ``similarity`` (share of the item's windows), ``slots`` (placeholder words met), ``agreement``.
    What is found only as written has those windows and their share, no slots and agreement 1.

    * Null, empty and wordless texts and items hold nothing and are found nowhere.
    * An item of fewer than five template words is found as written, one of fewer than five words in
      documents that consist of just it, in the same capitals.
    * Repeated documents and items are reported each for itself; null ids stay null.
    * An empty table on either side gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, windows long, similarity double, slots long, agreement double"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, limit):
        shared = spark.sparkContext.broadcast(vars(block))

        def run(batches, shared=shared):
            block = Block.of(shared.value)
            for batch in slices(batches):
                found = _found(block, batch.column("text"))
                if found:
                    row, item, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(row)), pa.array([block.ids[i] for i in item], pa.int64()),
                         *[pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.float64(), pa.int64(), pa.float64()))]],
                        ["doc_id", "item_id", "windows", "similarity", "slots", "agreement"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    for block in _blocks(benchmark, limit):
        shared = docs.sparkSession.sparkContext.broadcast(vars(block))

        def run(batches, shared=shared, at=docs.columns.index("text")):
            block = Block.of(shared.value)
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in _found(block, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


@query()
def op5_benchmark_decontamination(spark, folder):
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
