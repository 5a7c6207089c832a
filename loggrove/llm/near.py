"""Near-duplicate documents by an LSH forest of MinHash signatures.

A document's set is its distinct word shingles. 128 minima of random hash functions make its
signature, which is read in 32 orders (trees): order t begins with the minima 4t to 4t+3 and goes
on with those of the following trees. Documents that share the first four values of an order
form a region. Two sets of similarity 0.8 share four values of at least one order but for a chance
of 5e-8.

Within a region, neighbours are not paired with each other in full. Signature bits and set sizes
say which pairs can be links; a spanning forest over them and a star around the best-connected
document are proposed. Proposals are confirmed on full sets in turns, first two of each document, then
two of each component that these made, then all that still lie between components: the trees propose many
pairs of one large group, of which a few join it. Then a second pass proposes
every possible pair in a region whose documents are still in different components and that
was not tried before, so no possible link between different components is left untried.

A region of more than REGION documents is crowded. In the first pass its depth grows, 8, 16, 32
values, and at the greatest depth it is dealt into chunks: that joins most of what belongs
together, and misses some. In the second pass all members of crowded regions go through an exact
join instead: sets that overlap enough share one of their rarest shingles. The sets that meet under
a shingle are compared there, in full, and only links that join two components leave the task.

Documents of equal sets are one node, found before anything is paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loggrove.llm.links import components
from loggrove.llm.registry import query, table
from loggrove.llm.shelf import Shelf
from loggrove.llm.textcols import shingle_hashes, slices, splitmix, text_bytes, word_hashes
from loggrove.scratch import written

TREES, FIRST = 32, 4
HASHES = TREES * FIRST
DEPTHS = (4, 8, 16, 32)
REGION = 128
GROUP = 1024  # a shingle of more members than about this is dealt into blocks, and every two blocks meet
GROUP_IDS = 1 << 20  # likewise where its members' sets have more shingles together
PLACES = 1 << 26  # hashed places of ids, a bit each: where more ids are asked for, more texts are read in vain
BUCKETS = 1 << 20  # shingles are counted in so many buckets; the counts only order them
# Of 64 signature bits, two sets of similarity 0.8 differ in 6.4 on average and in over 22 with a chance of 2e-8.
# Of the low bytes of 256 further minima they differ in 51 on average and in over 90 with a chance of 4e-9.
MOST_COARSE, MOST_FINE, FINE = 22, 90, 256
SIMILARITY = 80
TURNS = 2  # turns in which each component confirms two of its proposals, before all that are left

_RANDOM = np.random.default_rng(20240611)
# The first HASHES functions make signatures, the others fine sketches.
_FACTORS = _RANDOM.integers(0, 2**63, HASHES + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**63, HASHES + FINE, dtype=np.uint64)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    shingles, offsets = shingle_hashes(*word_hashes(column), size)
    for i in range(len(offsets) - 1):
        yield np.unique(shingles[offsets[i]:offsets[i + 1]])


def _keys(members: np.ndarray) -> tuple[np.int64, np.int64]:
    """Two 64-bit names of a set."""
    return (splitmix(members).sum(dtype=np.uint64).view(np.int64), splitmix(members ^ _SECOND).sum(dtype=np.uint64).view(np.int64))


def _minima(members: np.ndarray, of: slice) -> np.ndarray:
    """16 bits of the minimum of each of some hash functions, scrambled: minima of large sets all begin with zeros."""
    factors, terms = _FACTORS[of], _TERMS[of]
    lowest = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), 2048):
        hashed = np.multiply.outer(factors, members[at:at + 2048])
        hashed += terms[:, None]
        np.minimum(lowest, hashed.min(axis=1), out=lowest)
    return (splitmix(lowest) >> np.uint64(48)).astype("<u2")


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``k1``, ``k2`` (the set's name), ``signature`` per row."""

    def run(batches):
        for batch in slices(batches):
            n, k1, k2, made = [], [], [], []
            for members in _sets(batch.column("text"), size):
                n.append(len(members))
                a, b = _keys(members)
                k1.append(a)
                k2.append(b)
                made.append(_minima(members, slice(HASHES)).tobytes() if len(members) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(k1, np.int64)), pa.array(np.array(k2, np.int64)),
                 pa.array(made, pa.binary())], ["doc_id", "n", "k1", "k2", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, k1 long, k2 long, signature binary")


def _distance(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many bits or bytes sketches (their last axis) differ, and the most that a link may."""
    if x.shape[-1] == FINE:
        return (x != y).sum(axis=-1, dtype=np.int16), MOST_FINE
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16), MOST_COARSE


def _keys_at(values: np.ndarray, rows: np.ndarray, trees: np.ndarray, depth: int) -> np.ndarray:
    """Names of the first ``depth`` values of some rows' signatures in some trees' orders."""
    key = splitmix(values[rows, trees] + trees.astype(np.uint64))
    for further in range(1, depth // FIRST):
        key = splitmix(key * np.uint64(31) + values[rows, (trees + further) % TREES])
    return key.view(np.int64)


def _tree_values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as minima, and as one 64-bit value of four minima per tree."""
    raw = text_bytes(batch.column("signature"))[0].view("<u2").reshape(batch.num_rows, HASHES)
    return raw, np.ascontiguousarray(raw).view("<u8")


def _coarse(raw: np.ndarray) -> np.ndarray:
    """64 bits of each signature, packed."""
    return np.packbits((raw[:, ::2] & 1).astype(np.uint8), axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a column."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [
        None, pa.py_buffer((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _orders(nodes: DataFrame) -> DataFrame:
    """Each node once per tree: ``key`` names its first values there."""

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            raw, values = _tree_values(batch)
            rows, trees = np.repeat(np.arange(m), TREES), np.tile(np.arange(TREES), m)
            sketches = _binary(np.repeat(_coarse(raw), TREES, axis=0))
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_keys_at(values, rows, trees, DEPTHS[0])), pa.array(trees.astype(np.int32)), batch.column("node").take(taken),
                 batch.column("n").take(taken), sketches, batch.column("comp").take(taken)], ["key", "tree", "node", "n", "sketch", "comp"])

    return nodes.select("node", "n", "signature", "comp").mapInArrow(run, ROW)


def _deepened(rows: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """``rows`` with keys of ``depth`` values in their trees. A node is asked for once, with all its trees."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, values = _tree_values(batch)
            lists = batch.column("trees")
            trees = lists.flatten().to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_keys_at(values, rows, trees, depth)), pa.array(trees.astype(np.int32)), batch.column("node").take(taken),
                 batch.column("n").take(taken), _binary(_coarse(raw)[rows]), batch.column("comp").take(taken)], ["key", "tree", "node", "n", "sketch", "comp"])

    trees = rows.groupBy("node").agg(F.collect_list("tree").alias("trees"))  # TREES at most
    return trees.join(nodes.select("node", "n", "signature", "comp"), "node").mapInArrow(run, ROW)


ROW = "key long, tree int, node long, n long, sketch binary, comp long"


def _regions(nodes: DataFrame, limit: int, deeper: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows (key, node, n, sketch, comp) whose keys name regions of at most about ``limit`` nodes, those of crowded
    regions ``deeper`` or not at all; and the ``node`` of all members of crowded regions, or None."""
    rows, found, members = _orders(nodes), [], None
    for depth in (*DEPTHS[1:], None):
        heavy = written(rows.groupBy("key").count().where(F.col("count") > limit), "heavy-regions")
        if heavy.isEmpty():
            found.append(rows)
            break
        marked = rows.join(heavy, "key", "left")
        found.append(marked.where("count IS NULL"))
        if not deeper:
            break
        crowded = marked.where("count IS NOT NULL")
        if depth:
            rows = written(_deepened(crowded.drop("count"), nodes, depth), "deeper-rows")
            members = written(rows.select("node").distinct(), "crowded") if members is None else members
        else:
            chunk = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("count") / limit))
            found.append(crowded.withColumn("key", F.xxhash64("key", chunk)))
    return reduce(DataFrame.unionByName, [f.select("key", "node", "n", "sketch", "comp") for f in found]), members


def _possible(n: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Which pairs of a region can be links: the more their sketches agree, the larger; 0 where they can't."""
    distance, most = _distance(sketch[:, None], sketch[None, :])
    equal = most + 1 - distance
    sizes = 100 * np.minimum(n[:, None], n[None, :]) >= SIMILARITY * np.maximum(n[:, None], n[None, :])
    equal[~sizes | (equal < 0)] = 0
    np.fill_diagonal(equal, 0)
    return equal


def _sparse(equal: np.ndarray, node: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of most agreement, and a star around the node with most possible links: the smallest of
    several, so that the trees' regions of one group choose few different ones."""
    m = len(equal)
    hub = int(np.lexsort((node, -(equal > 0).sum(axis=1)))[0])
    pairs = [(hub, int(i)) for i in np.flatnonzero(equal[hub])]
    outside = np.ones(m, bool)
    best, parent = np.full(m, -1, np.int16), np.full(m, -1)
    for _ in range(m):
        at = int(np.where(outside, best, -2).argmax())
        if best[at] > 0 and hub not in (at, parent[at]):
            pairs.append((int(parent[at]), at))
        outside[at] = False
        nearer = outside & (equal[at] > best) & (equal[at] > 0)
        best[nearer], parent[nearer] = equal[at][nearer], at
    return pairs


def _proposals(regions: DataFrame, across: bool) -> DataFrame:
    """Pairs (a < b) of nodes to be confirmed: sparse ones of each region, or all between components but those of two
    ``settled`` nodes. ``equal`` tells how far their sketches agree."""

    def of_region(node, n, sketch, comp, settled):
        equal = _possible(n, sketch)
        if across:
            equal[(comp[:, None] == comp[None, :]) | (settled[:, None] & settled[None, :])] = 0
            left, right = np.nonzero(np.triu(equal))
        elif equal.any():
            left, right = np.array(_sparse(equal, node)).T
        else:
            return None
        return np.minimum(node[left], node[right]), np.maximum(node[left], node[right]), equal[left, right]

    def resolve(parts):
        key, node, n, sketch, comp, settled = parts
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(key)))
        twos = starts[sizes == 2]
        distance, most = _distance(sketch[twos], sketch[twos + 1])
        fits = (distance <= most) & (
            100 * np.minimum(n[twos], n[twos + 1]) >= SIMILARITY * np.maximum(n[twos], n[twos + 1]))
        if across:
            fits &= (comp[twos] != comp[twos + 1]) & ~(settled[twos] & settled[twos + 1])
        twos = twos[fits]
        out = [(np.minimum(node[twos], node[twos + 1]), np.maximum(node[twos], node[twos + 1]), (most + 1 - distance)[fits])]
        for at, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            one = slice(at, at + size)
            if across and ((comp[one] == comp[at]).all() or settled[one].all()):
                continue
            found = of_region(node[one], n[one], sketch[one], comp[one], settled[one])
            if found is not None:
                out.append(found)
        a, b, equal = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(equal.astype(np.int32))], ["a", "b", "equal"])

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "n", "comp", "settled")]
            parts.insert(3, text_bytes(batch.column("sketch"))[0].reshape(batch.num_rows, -1))
            if kept is not None:
                parts = [np.concatenate(x) for x in zip(kept, parts)]
            last = int(np.searchsorted(parts[0], parts[0][-1]))  # the last region may go on in the next batch
            kept = [x[last:] for x in parts]
            yield resolve([x[:last] for x in parts])
        if kept is not None:
            yield resolve(kept)

    if "settled" not in regions.columns:
        regions = regions.withColumn("settled", F.lit(False))
    placed = regions.select("key", "node", "n", "sketch", "comp", "settled").repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(run, "a long, b long, equal int").distinct()


def _bucket_counts(members: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each bucket."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            counts += np.bincount(_buckets(batch.column("members").flatten().to_numpy()), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "times"])

    counted = members.select("members").mapInArrow(run, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times")).toArrow()
    out = np.zeros(BUCKETS, np.int64)  # BUCKETS rows at most
    out[counted["bucket"].to_numpy()] = counted["times"].to_numpy()
    return out


def _buckets(members: np.ndarray) -> np.ndarray:
    return (members.view(np.uint64) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _prefixes(sets: DataFrame) -> DataFrame:
    """Each set once per shingle of its longer prefix: ``key``, ``node``, ``n``, ``sketch``, ``comp``, ``short``.

    Shingles are ordered by their buckets' counts and names. Sets x and y, y no larger, of similarity 0.8
    have 4 (x + y) / 9 shingles in common, at least 8 y / 9 and 0.8 x; so the first x - 0.8 x + 1 of x and the first
    y - 8 y / 9 + 1 of y (``short``) share one. What stands alone in its bucket is met nowhere else.
    """
    shared = sets.sparkSession.sparkContext.broadcast(_bucket_counts(sets))

    def run(batches):
        times = shared.value
        for batch in batches:
            keys, shorts, taken = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
            if not batch.num_rows:
                continue
            lists = batch.column("members")
            sketches = _coarse(_tree_values(batch)[0])
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i in range(batch.num_rows):
                members = flat[offsets[i]:offsets[i + 1]]
                n, often = len(members), times[_buckets(members)]
                first = np.lexsort((members, often))[:n - (4 * n + 4) // 5 + 1]
                short = np.arange(len(first)) < n - (8 * n + 8) // 9 + 1
                met = often[first] > 1
                keys.append(members[first][met])
                shorts.append(short[met])
                taken.append(np.full(int(met.sum()), i))
            rows = np.concatenate(taken)
            node, n, comp = (batch.column(c).take(pa.array(rows)) for c in ("node", "n", "comp"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), node, n, _binary(sketches[rows]), comp, pa.array(np.concatenate(shorts))],
                ["key", "node", "n", "sketch", "comp", "short"])

    return sets.select("node", "n", "signature", "comp", "members").mapInArrow(run, "key long, node long, n long, sketch binary, comp long, short boolean")


class _Group:
    """Sets that share a shingle of their prefixes: which are linked, told from the full sets."""

    def __init__(self, node, n, sketch, comp, short, block, members, offsets):
        self.node, self.n, self.sketch, self.short, self.block = node, n, sketch, short, block
        self.members, self.offsets = members, offsets
        self.label = np.unique(comp, return_inverse=True)[1]

    def links(self, spanning: bool) -> list[tuple[int, int]]:
        """Pairs of places whose sets have 100 * intersection >= 80 * union and lie in different components; if
        ``spanning`` only those that join two components that no earlier pair has joined."""
        names = np.unique(self.members, return_inverse=True)[1] if len(self.members) else self.members
        mark, out = np.zeros(len(self.members) + 1, bool), []
        meeting = self.block.min() != self.block.max()
        for x in range(len(self.node)):
            # Sets no larger than x, each with its short prefix; of equal ones each pair once.
            other = self.short & (100 * self.n >= SIMILARITY * self.n[x]) & ((self.n < self.n[x]) | ((self.n == self.n[x]) & (self.node < self.node[x])))
            other &= self.label != self.label[x]
            if meeting:
                other &= self.block != self.block[x]
            other = np.flatnonzero(other)
            distance, most = _distance(self.sketch[x], self.sketch[other])
            near = distance <= most
            other = other[near][np.argsort(distance[near], kind="stable")]
            own = names[self.offsets[x]:self.offsets[x + 1]]
            mark[own] = True
            for at in range(0, len(other), 64):  # the likeliest first: once x is joined, most others are in its component
                asked = other[at:at + 64]
                if spanning:
                    asked = asked[self.label[asked] != self.label[x]]
                common = np.array([np.count_nonzero(mark[names[self.offsets[y]:self.offsets[y + 1]]]) for y in asked], np.int64)
                for y in asked[100 * common >= SIMILARITY * (self.n[x] + self.n[asked] - common)]:
                    if spanning:
                        if self.label[y] == self.label[x]:
                            continue
                        self.label[self.label == self.label[y]] = self.label[x]
                    out.append((x, y))
            mark[own] = False
        return out


def _met_in_crowds(sets: DataFrame, group: int = GROUP, spanning: bool = False) -> DataFrame:
    """Links (a < b) between sets of different components that share a shingle of their prefixes, confirmed on the full sets.

    All of them, or with ``spanning`` as many as join the components that meet under a shingle: one fewer than its members at most.
    """
    rows = written(_prefixes(sets), "prefixes")
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.sum("n").alias("ids"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("short").alias("any"))
    # Only shingles whose sets are not all of one component are of use.
    torn = written(often.where(F.col("any") & (F.col("low") < F.col("high"))).select(
        "key", F.greatest(F.ceil(F.col("times") / group), F.ceil(F.col("ids") / GROUP_IDS)).alias("blocks")), "torn-shingles")
    mine = F.pmod(F.xxhash64("node", "key"), F.col("blocks"))
    # Every two blocks of a shingle meet under a key of their own.
    meetings = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.xxhash64("key", F.least(mine, other), F.greatest(mine, other)))
    dealt = rows.join(torn, "key").select(F.explode(F.when(F.col("blocks") > 1, meetings).otherwise(F.array("key"))).alias("key"), "node", "n", "sketch", "comp", "short", mine.alias("block"))
    asked = rows.join(torn, "key").select("node")
    dealt = dealt.join(_asked_for(sets.select("node", "members"), asked), "node").select("key", "node", "n", "sketch", "comp", "short", "block", "members")
    names = ("key", "node", "n", "comp", "short", "block")

    def resolve(held):
        key, node, n, comp, short, block, sketch, members, sizes = held
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        a, b = [], []
        for start, end in zip(starts, np.append(starts[1:], len(key))):
            one = slice(start, end)
            if comp[one].min() == comp[one].max() or not short[one].any():
                continue
            found = _Group(node[one], n[one], sketch[one], comp[one], short[one], block[one], members[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start])
            for x, y in found.links(spanning):
                a.append(min(node[start + x], node[start + y]))
                b.append(max(node[start + x], node[start + y]))
        return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("members")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            parts = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            parts += [text_bytes(batch.column("sketch"))[0].reshape(batch.num_rows, -1), lists.values.to_numpy()[offsets[0]:offsets[-1]], np.diff(offsets)]
            if held is not None:
                parts = [np.concatenate(x) for x in zip(held, parts)]
            last = int(np.searchsorted(parts[0], parts[0][-1]))  # the last shingle may go on in the next batch
            before = int(parts[8][:last].sum())
            cut = [last] * 7 + [before, last]
            if last:
                yield resolve([x[:i] for x, i in zip(parts, cut)])
            held = [x[i:] for x, i in zip(parts, cut)]
        if held is not None:
            yield resolve(held)

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def _place(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(PLACES))


def _place_words(asked: DataFrame, column: str) -> DataFrame:
    """A bit for each place that ``column`` of some row hashes to, as ``bits`` of 64 places by ``word``."""
    bits = F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))")
    return asked.select(_place(column).alias("place")).groupBy(F.expr("place div 64").alias("word")).agg(bits.alias("bits"))


def _asked_for(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """``sets`` without most of the rows whose ``node`` is not in ``asked``, left out where they are read."""
    words = F.broadcast(_place_words(asked, "node"))  # PLACES / 64 rows at most
    placed = sets.withColumn("_place", _place("node")).withColumn("word", F.expr("_place div 64")).join(words, "word")
    return placed.where("(shiftright(bits, CAST(_place % 64 AS INT)) & 1L) = 1").select(*sets.columns)


def _places(asked: DataFrame) -> np.ndarray:
    """A bit for each place that the ``doc_id`` of some row hashes to."""
    words = _place_words(asked, "doc_id").toArrow()
    out = np.zeros(PLACES // 64, np.int64)  # PLACES / 64 rows at most
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _at_places(batches, words: np.ndarray):
    """The rows whose ``place`` has its bit set."""
    for batch in batches:
        place = batch.column("place").to_numpy()
        yield batch.filter(pa.array((words[place >> 6] >> (place & 63)) & 1 == 1))


def _member_sets(ids: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``node``, its full set (``members``) and fine ``sketch``, of every ``node`` in ``ids``."""
    needed = written(nodes.join(ids, "node").select("node", "doc_id", "k1", "k2"), "needed")
    shared = needed.sparkSession.sparkContext.broadcast(_places(needed))

    def run(batches):
        for batch in slices(_at_places(batches, shared.value)):
            k1, k2, sets, sketches = [], [], [], []
            for members in _sets(batch.column("text"), size):
                a, b = _keys(members)
                k1.append(a)
                k2.append(b)
                sets.append(members.view(np.int64))
                sketches.append((_minima(members, slice(HASHES, None)) & 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(k1, np.int64)), pa.array(np.array(k2, np.int64)), pa.array(sets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["k1", "k2", "members", "sketch"])

    # No text is sent to another task: a row whose id is surely not asked for is left out where it is read, and the
    # few others that are not asked for find no partner below.
    texts = docs.select(_place("doc_id").alias("place"), "text")
    sets = texts.mapInArrow(run, "k1 long, k2 long, members array<long>, sketch binary")
    # Rows that repeat an id can give a set twice; one of them is enough, and sets travel once.
    once = sets.groupBy("k1", "k2").agg(F.first("members").alias("members"), F.first("sketch").alias("sketch"))
    return written(once.join(needed.hint("merge"), ["k1", "k2"]).select("node", "members", "sketch"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs whose full sets have 100 * intersection >= 80 * union."""
    sets = _asked_for(sets, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("of_b"))
    # One plan at every size: sets grow with the input, so they are never broadcast.
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * common >= SIMILARITY * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def _foremost(pairs: DataFrame) -> DataFrame:
    """Of each component (``of_a``, ``of_b``) the pair that agrees most and the one that leads to the smallest component."""
    turned = F.array(F.struct(F.col("of_a").alias("one"), F.col("of_b").alias("other")), F.struct(F.col("of_b").alias("one"), F.col("of_a").alias("other")))
    ends = pairs.select("a", "b", "equal", F.explode(turned).alias("_ends")).select("a", "b", "equal", "_ends.*")
    best = ends.groupBy("one").agg(
        F.min(F.struct((-F.col("equal")).alias("unlike"), "other", "a", "b")).alias("nearest"),
        F.min(F.struct("other", (-F.col("equal")).alias("unlike"), "a", "b")).alias("lowest"))
    return best.select(F.explode(F.array(F.struct("nearest.a", "nearest.b"), F.struct("lowest.a", "lowest.b"))).alias("_pair")).select("_pair.*").distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those pairs that lie between two components, ``of_a`` and ``of_b``."""
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias(end), F.col("comp").alias("_comp"))
        pairs = pairs.join(of, end, "left").withColumn(f"of_{end}", F.coalesce("_comp", end)).drop("_comp")
    return pairs.where("of_a <> of_b")


def _grown(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components under further links."""
    return components(links if labels is None else labels.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).union(links))


def _joined(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Components under all links among ``pairs``, as labels. Every pair is confirmed but those within a component."""
    labels, left = None, pairs.withColumns({"of_a": F.col("a"), "of_b": F.col("b")})
    for _ in range(TURNS):
        chosen = written(_foremost(left), "chosen")
        labels = _grown(labels, written(_confirmed(chosen, sets), "confirmed"))
        left = written(_apart(left.select("a", "b", "equal").join(chosen, ["a", "b"], "left_anti"), labels), "left-pairs")
        if left.isEmpty():
            return labels
    links = written(_confirmed(left.select("a", "b"), sets), "confirmed")
    return labels if links.isEmpty() else _grown(labels, links)


def near_components(docs: DataFrame, size: int = 5, limit: int = REGION) -> DataFrame:
    """Components of the documents under links of shingle-set similarity 0.8 or more.

    Returns one row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id
    reachable) and ``kept`` (doc_id = component_id).

    * Words are runs of other bytes than 20 and 09 to 0D, A-Z lower-cased; a text of fewer than
      ``size`` words has its whole sequence as its one shingle.
    * Null, empty and blank texts have no shingle, are linked with nothing and are their own component.
    * Rows that repeat an id are nodes of their own: equal sets share a component, others do not.
    * Null ids count only where a component has no other; such a row's component is null and it is kept.
    * An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    shelf = Shelf(docs.sparkSession)
    signed = shelf.put(signatures(docs, size), "signatures")
    classes = signed.where("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    nodes = written(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    made = written(signed.select("doc_id", "n", "k1", "k2"), "keys")
    shelf.drop("signatures")  # nodes have those of each set once

    regions, crowded = _regions(nodes.withColumn("comp", F.col("node")), limit, deeper=True)
    first = written(_proposals(regions, across=False), "proposals")
    shelf.drop()
    active = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    # Of all nodes that have a possible link at all.
    sets = _member_sets(active if crowded is None else active.union(crowded).distinct(), nodes, docs, size)
    labels = _joined(first, sets)
    shelf.drop()
    again = nodes.join(active, "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    again = shelf.put(again, "active")
    regions = shelf.put(_regions(again, limit, deeper=False)[0].drop("sketch"), "regions")
    shelf.drop("active")
    # Only regions of several components are left, and finer sketches tell more pairs that can't be links.
    torn = regions.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    regions = regions.join(torn, "key", "left_semi").join(sets.select("node", "sketch"), "node")
    if crowded is not None:  # two members of crowded regions meet in the exact join below
        marked = crowded.withColumn("settled", F.lit(True))
        regions = regions.join(marked, "node", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    untried = _proposals(regions, across=True)
    # What was proposed before and still lies between components is no link.
    second = written(untried.select("a", "b").join(first.select("a", "b"), ["a", "b"], "left_anti"), "second-proposals")
    shelf.drop("regions")
    found = [written(_confirmed(second, sets), "confirmed")]
    if crowded is not None:
        known = nodes.select("node", "n", "signature").join(crowded, "node").join(labels, "node", "left")
        known = known.withColumn("comp", F.coalesce("comp", "node")).join(_asked_for(sets.select("node", "members"), crowded), "node")
        found.append(written(_met_in_crowds(known, spanning=True), "crowd-links"))
    further = [f for f in found if not f.isEmpty()]
    if further:
        labels = _grown(labels, reduce(DataFrame.union, further))
    joined = nodes.select("node", "k1", "k2", "doc_id").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # Written, so that the join's large parts can be split at run time.
    smallest = written(joined.groupBy("comp").agg(F.min("doc_id").alias("component")), "smallest")
    named = joined.join(smallest, "comp").select("k1", "k2", "component")
    out = made.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, size: int = 5) -> DataFrame:
    """One document of each component, with all its columns, whatever their names.

    * Documents without shingles (null, empty and blank texts) stay. An empty table gives an empty result.
    * An id with several rows stays if one of them is kept. Rows with a null id have no id to tell them apart:
      those go whose set belongs to a component with an id, the others stay.
    """
    found = written(near_components(docs, size), "near")
    kept = found.where("kept").select("doc_id").distinct()
    dropped = found.where("not kept").select("doc_id").distinct().join(kept, "doc_id", "left_anti").withColumnRenamed("doc_id", "_dropped")
    named = docs.where("doc_id IS NOT NULL")
    out = named.join(dropped, named["doc_id"] == dropped["_dropped"], "left_anti")
    unnamed = docs.where("doc_id IS NULL")
    if found.where("doc_id IS NULL AND NOT kept").isEmpty():
        return out.unionByName(unnamed)
    return out.unionByName(_unnamed_kept(docs, unnamed, found, size))


def _unnamed_kept(docs: DataFrame, unnamed: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """The rows without id whose component has none either: they are asked again with ids below all others."""
    lowest = found.agg(F.min("component_id")).first()[0]
    numbered = written(unnamed.select(F.struct(*unnamed.columns).alias("_document"), F.monotonically_increasing_id().alias("_place"), F.col("text")), "unnamed")
    asked = numbered.select((F.lit(lowest) - 1 - F.col("_place")).alias("doc_id"), "text")
    both = near_components(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(asked), size)
    joined = both.withColumn("named", F.col("doc_id") >= lowest)
    mixed = joined.groupBy("component_id").agg(F.max("named").alias("has_id"))
    gone = joined.where("NOT named").join(mixed, "component_id").where("has_id").select((F.lit(lowest) - 1 - F.col("doc_id")).alias("_place"))
    return numbered.join(gone, "_place", "left_anti").select("_document.*")


@query()
def op3_near_dedup(spark, folder):
    return near_components(table(spark, folder, "documents"), size=2)
