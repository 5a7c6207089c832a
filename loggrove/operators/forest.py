"""Isolation Forests (Liu, Ting and Zhou 2008) as Spark jobs.

Fitting: every tree gets its own random sample of rows, drawn by hash so the
result does not depend on partitioning; all trees of all models are then grown in
one grouped job. Where a sample is too large for one task, equal rows are counted,
and crowded nodes are split from their bounds before their rows are dealt. Scoring: the node table is sent to the tasks in passes of bounded
size and rows are scored in Arrow batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from loggrove.operators.ordering import exact_quantiles
from loggrove.schema import ANOMALY, NORMAL, SEED, TRAINING_FEATURES
from loggrove.scratch import written

# --- fixed values ----------------------------------------------------------
DEFAULT_TREES = 100
DEFAULT_ROWS = 256
DEFAULT_CUT = 0.5

SHARE_OF = 131_072              # a share of the rows is a share of so many at most, unless settings say otherwise
TREE_ROWS = SHARE_OF            # a tree of more rows is grown from counts of equal rows
TASK_ROWS = 1 << 19             # rows of a tree that are grown in one task, equal ones counted once
BIN_BITS = 10                   # of the hash of a row, by which rows are counted
REPEATS_AT_ONCE = 1 << 20       # rows whose draws are counted at a time
ROWS_PER_PASS = 2_000_000       # sampled rows ordered by one task
PASS_NODES = 4_000_000          # nodes that are sent to the tasks at a time, 22 bytes each
PASSES_AT_ONCE = 4              # passes whose nodes a Python worker holds together
CELLS = 1 << 16                 # rows times trees that are walked at a time
KNOWN_ROWS = 1 << 19            # distinct rows whose path lengths a Python worker remembers, about 220 bytes each

NODE_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("rows", T.LongType()), T.StructField("path", T.DoubleType()),
])


@dataclass(frozen=True)
class ForestParams:
    trees: int = DEFAULT_TREES
    rows_per_tree: int | float = DEFAULT_ROWS   # a count, or a share of the training rows (of ``share_of`` rows at most)
    feature_share: float = 1.0
    bootstrap: bool = False
    contamination: float | None = None          # None: the fixed cut
    features: tuple[str, ...] = TRAINING_FEATURES
    seed: int = SEED
    share_of: int | None = SHARE_OF             # None: a share is one of all training rows

    def sample_rows(self, n: int) -> int:
        if isinstance(self.rows_per_tree, int):
            return max(1, min(self.rows_per_tree, n))
        return max(1, int(self.rows_per_tree * (n if self.share_of is None else min(n, self.share_of))))


def average_path(rows) -> np.ndarray:
    """Average path length of an unsuccessful search among ``rows`` values."""
    n = np.asarray(rows, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def drawn_features(width: int, share: float, rng: np.random.Generator) -> np.ndarray:
    return np.sort(rng.permutation(width)[: max(1, int(share * width))])


def grow_tree(values: np.ndarray, feature_share: float, rng: np.random.Generator, times: np.ndarray | None = None,
              start: int = 0, limit: int | None = None) -> dict[str, np.ndarray]:
    """One isolation tree, grown level by level over all open nodes at once.

    A row counts as many ``times`` as told. With ``start`` and ``limit`` this is what
    hangs below a node of depth ``start`` in a tree of that height.
    """
    times = np.ones(len(values), dtype=np.int64) if times is None else times
    n = int(times.sum())
    used = drawn_features(values.shape[1], feature_share, rng)
    values = values[:, used]
    limit = _depth(n) if limit is None else limit
    # One array per level; the last one holds the level that is being split.
    feature, threshold = [np.array([-1])], [np.array([0.0])]
    left, right = [np.array([0])], [np.array([0])]
    size, depth = [np.array([n])], [np.array([start])]
    total = 1
    order, home = np.arange(len(values)), np.zeros(len(values), dtype=np.int64)  # rows of open nodes and the node of each
    for level in range(start, limit):
        if not len(order):
            break
        nodes, starts = np.unique(home, return_index=True)
        block = values[order]
        low, high = np.minimum.reduceat(block, starts, axis=0), np.maximum.reduceat(block, starts, axis=0)
        draw = np.where(high > low, rng.random(low.shape), -1.0)
        pick = draw.argmax(axis=1)
        at = np.arange(len(nodes))
        splits = draw[at, pick] >= 0
        cut = low[at, pick] + rng.random(len(nodes)) * (high[at, pick] - low[at, pick])
        cut = np.where(cut >= high[at, pick], low[at, pick], cut)
        first = total + 2 * (np.cumsum(splits) - 1)
        counts = np.diff(np.append(starts, len(order)))
        local = np.repeat(at, counts)
        goes_left = block[np.arange(len(order)), pick[local]] <= cut[local]
        held = times[order]
        left_size = np.add.reduceat(np.where(goes_left, held, 0), starts)
        _fill(feature, threshold, left, right, nodes[splits], used[pick[splits]], cut[splits], first[splits])
        made = np.column_stack([left_size, np.add.reduceat(held, starts) - left_size])[splits].ravel()
        feature.append(np.full(len(made), -1))
        threshold.append(np.zeros(len(made)))
        left.append(np.zeros(len(made), dtype=np.int64))
        right.append(np.zeros(len(made), dtype=np.int64))
        size.append(made)
        depth.append(np.full(len(made), level + 1))
        total += len(made)
        keep = splits[local]
        home = np.where(goes_left, first[local], first[local] + 1)[keep]
        order = order[keep]
        sizes = np.concatenate(size)
        alive = sizes[home] > 1
        order, home = order[alive], home[alive]
        by_node = np.argsort(home, kind="stable")
        order, home = order[by_node], home[by_node]
    sizes, depths = np.concatenate(size), np.concatenate(depth)
    return {"feature": np.concatenate(feature), "threshold": np.concatenate(threshold), "left": np.concatenate(left),
            "right": np.concatenate(right), "rows": sizes, "path": depths + average_path(sizes)}


def _fill(feature, threshold, left, right, nodes, picks, cuts, first) -> None:
    """Turn leaves into inner nodes (the last chunks hold the current level)."""
    offset = sum(len(chunk) for chunk in feature[:-1])
    at = nodes - offset
    feature[-1][at], threshold[-1][at], left[-1][at], right[-1][at] = picks, cuts, first, first + 1


def resample(values: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A bootstrap sample from a without-replacement one.

    Drawing with replacement from n rows gives some pattern of repeats over a uniform
    set of distinct rows; the pattern is drawn here and laid over the (randomly
    ordered) rows at hand, which has the same distribution.
    """
    _, repeats = np.unique(rng.integers(0, n, len(values)), return_counts=True)
    return np.repeat(values[: len(repeats)], repeats, axis=0)


def repeat_counts(draws: int, n: int, rng: np.random.Generator) -> list[int]:
    """How many of ``n`` rows are taken once, twice and so on by so many draws with replacement."""
    found: list[int] = []
    while n and draws:
        part = min(n, REPEATS_AT_ONCE)
        took = draws if part == n else int(rng.binomial(draws, part / n))
        counts = np.bincount(np.bincount(rng.integers(0, part, took), minlength=part))[1:]
        found += [0] * (len(counts) - len(found))
        for i, count in enumerate(counts):
            found[i] += int(count)
        n, draws = n - part, draws - took
    return found


@dataclass
class Forest:
    """Fitted models: node table, settings, score cut and training vocabulary."""

    nodes: DataFrame
    params: dict[str, ForestParams]
    samples: dict[str, int]
    cuts: dict[str, float] = field(default_factory=dict)
    vocab: DataFrame | None = None
    parts: dict[tuple[str, int], list[int]] = field(default_factory=dict)  # where the parts of a large tree begin among its nodes

    def save(self, path: str) -> None:
        self.nodes.write.parquet(f"{path}/nodes")
        if self.vocab is not None:
            self.vocab.write.parquet(f"{path}/vocab")
        parts = {m: json.dumps([[tree, starts] for (of, tree), starts in self.parts.items() if of == m]) for m in self.params}
        rows = [(m, json.dumps(asdict(p)), self.samples[m], self.cuts.get(m), self.vocab is not None, parts[m]) for m, p in self.params.items()]
        self.nodes.sparkSession.createDataFrame(rows, "model string, params string, sample long, cut double, has_vocab boolean, parts string").coalesce(
            1).write.parquet(f"{path}/models")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        rows = spark.read.parquet(f"{path}/models").collect()
        params = {}
        for row in rows:
            values = json.loads(row["params"])
            params[row["model"]] = ForestParams(**{**values, "features": tuple(values["features"])})
        return cls(spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes"), params, {r["model"]: r["sample"] for r in rows},
                   {r["model"]: r["cut"] for r in rows if r["cut"] is not None},
                   spark.read.parquet(f"{path}/vocab") if rows and rows[0]["has_vocab"] else None,
                   {(r["model"], tree): starts for r in rows if "parts" in r for tree, starts in json.loads(r["parts"])})


def _sampling_plan(sizes: dict[str, int], params: dict[str, ForestParams]) -> list[tuple]:
    plan = []
    for model, p in params.items():
        n = sizes[model]
        rows = p.sample_rows(n)
        per_pass = max(1, min(p.trees, n // rows, max(1, ROWS_PER_PASS // rows)))
        needed = per_pass * rows
        # Rows are let through by hash: enough that `needed` of them remain beyond doubt.
        share = min(1.0, (needed + 10.0 * math.sqrt(needed) + 100.0) / n)
        plan.append((model, p.seed, rows, per_pass, math.ceil(p.trees / per_pass), p.trees, min(2**63 - 1, int(share * 2**63)), needed))
    return plan


def fit(frame: DataFrame, params: ForestParams | dict[str, ForestParams], model_col: str | None = None, key: str = "block_id",
        vocab: DataFrame | None = None) -> Forest:
    """Grow all trees of all models in one job. With ``model_col`` each model is fitted
    on its own rows; without it there is one model.

    A random order of the rows is cut into disjoint runs, one per tree; when the rows
    do not suffice for all trees a further random order (a pass) serves the rest.
    Trees of more than TREE_ROWS rows are grown by ``_large_trees``.
    """
    if isinstance(params, ForestParams):
        params = {"model": params}
    names = sorted({c for p in params.values() for c in p.features})
    rows = frame.select(
        (F.col(model_col).cast("string") if model_col else F.lit(next(iter(params)))).alias("model"),
        F.col(key).cast("string").alias("_key"), *[F.col(c).cast("double").alias(c) for c in names])
    sizes = {r["model"]: r["count"] for r in rows.groupBy("model").count().collect()}
    samples = {}
    for model, p in params.items():
        if not sizes.get(model, 0):
            raise ValueError(f"no training rows for model {model}")
        samples[model] = p.sample_rows(sizes[model])
    numbers = {m: i for i, m in enumerate(sorted(params))}
    small, large = ({m: p for m, p in params.items() if (samples[m] > TREE_ROWS) == big} for big in (False, True))
    nodes, parts = [_small_trees(rows, names, sizes, small, numbers)] if small else [], {}
    if large:
        grown, parts = _large_trees(rows, sizes, large, numbers)
        nodes.append(grown)
    return Forest(written(reduce(lambda a, b: a.unionByName(b), nodes), "forest"), dict(params), samples, {}, vocab, parts)


def _small_trees(rows: DataFrame, names: list[str], sizes: dict[str, int], params: dict[str, ForestParams], numbers: dict[str, int]) -> DataFrame:
    """The nodes of trees whose rows one task takes as they are."""
    plan = _sampling_plan(sizes, params)
    spark = rows.sparkSession
    # One row per model.
    table = spark.createDataFrame(plan, "model string, _seed long, _rows long, _per_pass long, _passes long, _trees long, _share long, _needed long")
    hashed = _in_passes(rows, table).where(F.col("_hash") <= F.col("_share"))
    order = Window.partitionBy("model", "_pass").orderBy("_hash", "_key")
    placed = hashed.withColumn("_place", F.row_number().over(order) - 1).where(F.col("_place") < F.col("_needed"))
    placed = placed.withColumn("tree", (F.col("_pass") * F.col("_per_pass") + F.floor(F.col("_place") / F.col("_rows"))).cast("int"))
    total = sum(p.trees for p in params.values())
    workers = max(1, min(total, 4 * spark.sparkContext.defaultParallelism))
    grouped = placed.where(F.col("tree") < F.col("_trees")).select("model", "tree", "_place", *names).repartition(workers, "model", "tree")
    settings = {m: (tuple(names.index(c) for c in p.features), p.feature_share, p.bootstrap, p.seed, sizes[m]) for m, p in params.items()}

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        model, tree = str(group["model"].iloc[0]), int(group["tree"].iloc[0])
        columns, share, bootstrap, seed, n = settings[model]
        values = group.sort_values("_place")[names].to_numpy(dtype=float)[:, list(columns)]
        rng = np.random.default_rng([seed, numbers[model], tree])
        if bootstrap:
            values = resample(values, n, rng)
        return _node_rows(grow_tree(values, share, rng), model, tree)

    return grouped.groupBy("model", "tree").applyInPandas(grow, NODE_SCHEMA)


def _in_passes(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of each model in ``table`` once for each of its passes, with the hash that orders them."""
    every = rows.join(F.broadcast(table), "model").withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_passes") - 1)))
    return every.withColumn("_hash", F.shiftrightunsigned(F.xxhash64("_seed", "model", "_pass", "_key"), 1))


def _node_rows(grown: dict[str, np.ndarray], model: str, tree: int) -> pd.DataFrame:
    return pd.DataFrame({"model": model, "tree": np.int32(tree), "node": np.arange(len(grown["rows"]), dtype=np.int32),
                         **{k: grown[k] for k in ("feature", "threshold", "left", "right", "rows", "path")}}).astype(
        {"feature": "int32", "left": "int32", "right": "int32"})


@dataclass
class _Tops:
    """Upper parts of large trees, in flat arrays of all trees: the first nodes are the roots, a right child follows its left one."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    tree: list[int]      # place in the list of trees
    depth: list[int]
    number: list[int]    # of the node in its tree
    made: list[int]      # nodes of each tree so far

    @classmethod
    def roots(cls, trees: int) -> "_Tops":
        return cls([0] * trees, [math.inf] * trees, [*range(trees)], [*range(trees)], [0] * trees, [0] * trees, [1] * trees)

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        first, tree = len(self.feature), self.tree[node]
        self.feature[node], self.threshold[node], self.left[node] = feature, threshold, first
        self.feature += [0, 0]
        self.threshold += [math.inf, math.inf]
        self.left += [first, first + 1]
        self.tree += [tree, tree]
        self.depth += [self.depth[node] + 1] * 2
        self.number += [self.made[tree], self.made[tree] + 1]
        self.made[tree] += 2
        return first, first + 1

    def homes(self, sample: DataFrame, names: list[str]) -> DataFrame:
        """Add ``home``: the node where a row ends up."""
        if len(self.feature) == len(self.made):
            return sample.withColumn("home", F.col("slot"))
        feature, threshold, left, levels = np.array(self.feature), np.array(self.threshold), np.array(self.left, dtype=np.int32), max(self.depth)

        @F.pandas_udf("int")
        def walk(slot: pd.Series, *columns: pd.Series) -> pd.Series:
            values = np.column_stack([np.asarray(c, dtype=float) for c in columns])
            values = np.where(np.isnan(values), np.inf, values)   # goes right, and stays at a leaf
            at, row = slot.to_numpy(dtype=np.int32), np.arange(len(values))
            for _ in range(levels):
                at = left[at] + (values[row, feature[at]] > threshold[at]).astype(np.int32)
            return pd.Series(at)

        return sample.withColumn("home", walk("slot", *names))


def _large_trees(rows: DataFrame, sizes: dict[str, int], params: dict[str, ForestParams],
                 numbers: dict[str, int]) -> tuple[DataFrame, dict[tuple[str, int], list[int]]]:
    """The nodes of trees that have more rows than one task should sort, and where the parts of such trees begin.

    A tree sees its own features alone, so rows that agree in them are counted ahead of the shuffle. While a node has more
    than TASK_ROWS distinct rows, it is split here from the bounds of its rows, one job for all such nodes of a level;
    what hangs below the other nodes is grown in tasks.
    """
    names = sorted({c for p in params.values() for c in p.features})
    trees, runs = _planned(sizes, params, numbers, names)
    sample = written(_drawn_rows(rows, names, params, runs), "tree-rows")
    tops, times, pieces = _split_tops(sample, names, trees)
    spark = rows.sparkSession
    settings = {}
    for home in pieces:
        model, tree, seed, limit, columns = trees[tops.tree[home]]
        settings[home] = (model, tree, [*seed, 2, tops.number[home]], tops.depth[home], limit, columns)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        home = int(group["home"].iloc[0])
        model, tree, seed, start, limit, columns = settings[home]
        values = group[names].to_numpy(dtype=float)[:, columns]
        grown = grow_tree(values, 1.0, np.random.default_rng(seed), group["times"].to_numpy(dtype=np.int64), start, limit)
        return _node_rows(grown, model, tree).assign(home=np.int32(home))

    # At most a few rows per TASK_ROWS distinct rows, and one per tree.
    asked = F.broadcast(spark.createDataFrame([(home,) for home in pieces], "home int"))
    workers = max(1, min(len(pieces), max(4 * spark.sparkContext.defaultParallelism, sum(pieces.values()) // TASK_ROWS)))
    grouped = tops.homes(sample, names).join(asked, "home").repartition(workers, "home")
    grown = grouped.groupBy("home").applyInPandas(grow, T.StructType([*NODE_SCHEMA.fields, T.StructField("home", T.IntegerType())]))
    if len(tops.feature) == len(trees) == len(pieces):
        return grown.drop("home"), {}
    return _put_together(written(grown, "pieces"), tops, times, trees)


def _put_together(grown: DataFrame, tops: _Tops, times: dict[int, int], trees: list[tuple]) -> tuple[DataFrame, dict[tuple[str, int], list[int]]]:
    """Whole trees: a piece's root keeps its number in the upper part, its other nodes follow the upper part and the pieces before."""
    sizes = dict(grown.groupBy("home").count().collect())  # one row per piece
    following, places, parts = [*tops.made], [], {}
    for home in sorted(sizes):
        slot = tops.tree[home]
        if tops.made[slot] > 1:
            parts.setdefault(trees[slot][:2], []).append(following[slot])
        places.append((home, tops.number[home], following[slot] - 1))
        following[slot] += sizes[home] - 1
    upper = []
    for node in range(len(tops.feature)):
        if node in sizes:
            continue
        model, tree, _, _, columns = trees[tops.tree[node]]
        path = tops.depth[node] + float(average_path([times[node]])[0])
        inner, first = tops.left[node] != node, tops.left[node]
        split = (columns.index(tops.feature[node]), tops.threshold[node], tops.number[first], tops.number[first + 1]) if inner else (-1, 0.0, 0, 0)
        upper.append((model, tree, tops.number[node], *split, times[node], path))
    spark = grown.sparkSession
    moved = grown.join(F.broadcast(spark.createDataFrame(places, "home int, _number int, _shift int")), "home")
    at = lambda c: F.when(F.col("feature") < 0, F.lit(0)).otherwise(F.col(c) + F.col("_shift"))
    moved = moved.withColumns({"node": F.when(F.col("node") == 0, F.col("_number")).otherwise(F.col("node") + F.col("_shift")), "left": at("left"), "right": at("right")})
    return moved.select(*NODE_SCHEMA.names).unionByName(spark.createDataFrame(upper, NODE_SCHEMA)), parts


def _planned(sizes: dict[str, int], params: dict[str, ForestParams], numbers: dict[str, int], names: list[str]) -> tuple[list[tuple], dict]:
    """The trees (model, number, seeds, height, places of its model's features), and for each model and pass
    (start, end, tree, times, used features as bits): runs of the random order, by how often their rows are drawn."""
    trees, runs = [], {}
    for model, p in params.items():
        n, columns = sizes[model], [names.index(c) for c in p.features]
        rows = p.sample_rows(n)
        per_pass = max(1, min(p.trees, n // rows))
        for tree in range(p.trees):
            rng = np.random.default_rng([p.seed, numbers[model], tree])
            used = sum(1 << columns[i] for i in drawn_features(len(columns), p.feature_share, rng))
            start = tree % per_pass * rows
            for times, count in enumerate(repeat_counts(rows, n, rng) if p.bootstrap else [rows], 1):
                if count:
                    runs.setdefault((model, tree // per_pass), []).append((start, start + count, len(trees), times, used))
                    start += count
            trees.append((model, tree, [p.seed, numbers[model], tree], _depth(rows), columns))
    return trees, runs


def _drawn_rows(rows: DataFrame, names: list[str], params: dict[str, ForestParams], runs: dict) -> DataFrame:
    """(slot, features, times): the distinct rows of every tree. Features it does not use are 0.

    Rows are counted by the first bits of their hash. Most of these bins lie within one run; only rows of the others are ordered.
    """
    spark = rows.sparkSession
    passes = {m: 1 + max(number for of, number in runs if of == m) for m in params}
    table = spark.createDataFrame([(m, p.seed, passes[m]) for m, p in params.items()], "model string, _seed long, _passes long")
    placed = _in_passes(rows.select("model", "_key", *[F.coalesce(c, F.lit(math.nan)).alias(c) for c in names]), table).withColumn(
        "_bin", F.shiftright("_hash", 63 - BIN_BITS).cast("int"))
    bins: dict = {}
    # At most 2 ** BIN_BITS rows per model and pass.
    for row in placed.groupBy("model", "_pass", "_bin").count().collect():
        bins.setdefault((row["model"], row["_pass"]), []).append((row["_bin"], row["count"]))
    whole, cut, edges = [], [], []
    for of, counted in bins.items():
        at, first, own = 0, 0, runs.get(of, [])
        for number, count in sorted(counted):
            while first < len(own) and own[first][1] <= at:
                first += 1
            here = []
            for run in own[first:]:
                if run[0] >= at + count:
                    break
                here.append(run)
            if len(here) == 1 and here[0][0] <= at and at + count <= here[0][1]:
                whole.append((*of, number, *here[0][2:]))
            elif here:
                cut.append((*of, number, at))
                edges += [(*of, number, *run) for run in here]
            at += count
    same, drawn = ["model", "_pass", "_bin"], "slot int, times int, _used long"
    certain = placed.join(F.broadcast(spark.createDataFrame(whole, f"model string, _pass long, _bin int, {drawn}")), same)
    order = Window.partitionBy(*same).orderBy("_hash", "_key", *names)
    near = placed.join(F.broadcast(spark.createDataFrame(cut, "model string, _pass long, _bin int, _at long")), same).withColumn(
        "_place", F.col("_at") + F.row_number().over(order) - 1)
    asked = F.broadcast(spark.createDataFrame(edges, f"model string, _pass long, _bin int, _start long, _end long, {drawn}"))
    near = near.join(asked, same).where((F.col("_place") >= F.col("_start")) & (F.col("_place") < F.col("_end")))
    seen = [F.when(F.col("_used").bitwiseAND(1 << i) != 0, F.col(c)).otherwise(F.lit(0.0)).alias(c) for i, c in enumerate(names)]
    taken = certain.select("slot", "times", *seen).unionByName(near.select("slot", "times", *seen))
    return taken.groupBy("slot", *names).agg(F.sum("times").alias("times"))


def _split_tops(sample: DataFrame, names: list[str], trees: list[tuple]) -> tuple[_Tops, dict[int, int], dict[int, int]]:
    """Upper parts in which no node that can be split has more than TASK_ROWS distinct rows; the rows of their nodes; and the distinct
    rows of those that are left to be grown."""
    tops = _Tops.roots(len(trees))
    times, pieces, open_nodes = {}, {}, [*range(len(trees))]
    bounds = [f(c).alias(f"{word}_{c}") for c in names for f, word in ((F.min, "low"), (F.max, "high"))]
    while open_nodes:
        asked = F.broadcast(sample.sparkSession.createDataFrame([(node,) for node in open_nodes], "home int"))
        own = sample.where(F.col("slot").isin(sorted({tops.tree[node] for node in open_nodes}))) if len(times) else sample
        # One row per open node.
        found = tops.homes(own, names).join(asked, "home").groupBy("home").agg(
            F.count(F.lit(1)).alias("_distinct"), F.sum("times").alias("_times"), *bounds).orderBy("home").collect()
        open_nodes = []
        for row in found:
            node, times[row["home"]] = row["home"], row["_times"]
            _, _, seed, limit, columns = trees[tops.tree[node]]
            if tops.depth[node] >= limit:
                continue
            if row["_distinct"] <= TASK_ROWS:
                pieces[node] = row["_distinct"]
                continue
            rng = np.random.default_rng([*seed, 1, tops.number[node]])
            low, high = (np.array([row[f"{word}_{names[c]}"] for c in columns]) for word in ("low", "high"))
            draw = np.where(high > low, rng.random(len(columns)), -1.0)
            pick = int(draw.argmax())
            if draw[pick] >= 0:
                at = low[pick] + rng.random() * (high[pick] - low[pick])
                open_nodes += tops.split(node, columns[pick], float(low[pick] if at >= high[pick] else at))
    return tops, times, pieces


def pack(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """All trees of one model in flat arrays, 22 bytes a node; a leaf points at itself, a right child follows its left one.

    Where only parts of a tree are there, a node whose children are missing is a leaf of path 0.
    """
    nodes = nodes.sort_values(["tree", "node"])
    tree, path = nodes["tree"].to_numpy(), nodes["path"].to_numpy()
    roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]).astype(np.int32)
    ends = np.append(roots[1:], len(tree))
    base, end = np.repeat(roots, ends - roots), np.repeat(ends, ends - roots)
    leaf = nodes["feature"].to_numpy() < 0
    own = np.arange(len(tree), dtype=np.int32)
    left = nodes["left"].to_numpy() + base
    if not np.array_equal(nodes["node"].to_numpy(), own - base) or (~leaf & (left >= end)).any():
        key, asked = ((tree.astype(np.int64) << 32) + nodes[c].to_numpy() for c in ("node", "left"))
        left = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        missing = ~leaf & (key[left] != asked)
        leaf, path = leaf | missing, np.where(missing, 0.0, path)
    return {
        "roots": roots, "feature": np.where(leaf, 0, nodes["feature"].to_numpy()).astype(np.int16),
        "threshold": np.where(leaf, np.inf, nodes["threshold"].to_numpy()),
        "left": np.where(leaf, own, left).astype(np.int32),
        "path": path,
    }


def mean_paths(flat: dict[str, np.ndarray], values: np.ndarray, depth: int, batch: int | None = None) -> np.ndarray:
    """Average path length over the trees, for each row; of itself so many rows at a time as stay in a processor's cache."""
    out = np.empty(len(values))
    values = np.where(np.isnan(values), np.inf, values)   # goes right, and stays at a leaf
    width, batch = values.shape[1], batch or max(1, CELLS // max(1, len(flat["roots"])))
    for start in range(0, len(values), batch):
        part = np.ascontiguousarray(values[start:start + batch]).ravel()
        rows = np.repeat(np.arange(len(part) // width, dtype=np.int32) * width, len(flat["roots"]))
        at = np.tile(flat["roots"], len(part) // width)
        for _ in range(depth):
            goes_right = part.take(rows + flat["feature"].take(at)) > flat["threshold"].take(at)
            at = flat["left"].take(at) + goes_right
        out[start:start + batch] = flat["path"].take(at).reshape(-1, len(flat["roots"])).mean(axis=1)
    return out


def _path_scale(sample: int) -> float:
    return float(average_path(np.array([sample]))[0]) or 1.0


def scores_from_paths(paths: np.ndarray, sample: int) -> np.ndarray:
    return np.power(2.0, -paths / _path_scale(sample))


def _depth(sample: int) -> int:
    return math.ceil(math.log2(max(sample, 2)))


def _tree_passes(forest: Forest, most: int) -> list[list[tuple]]:
    """What is sent to the tasks at a time: (model, first tree, end, nodes of its top, first node, end), of at most about ``most`` nodes.

    The last three are None for whole trees. A tree of more nodes is sent in several passes, each with its top.
    """
    bound = sum(2 * rows * forest.params[m].trees for m, rows in forest.samples.items())  # a tree has under twice as many nodes as rows
    if bound <= most:
        return [[(m, 0, p.trees, None, None, None) for m, p in forest.params.items()]]
    counts = forest.nodes.groupBy("model", "tree").count().orderBy("model", "tree").collect()  # one row per tree
    passes, held = [], most
    for model, tree, count in counts:
        starts = forest.parts.get((model, tree), [])
        units = [(count, (None, None, None))]
        if count > most and starts:
            top, first, units = starts[0], 0, []
            for start, end in zip(starts, [*starts[1:], count]):
                if end - max(first, top) + top > most and start > first and start > top:
                    units.append((start - max(first, top) + top, (top, first, start)))
                    first = start
            units.append((count - max(first, top) + top, (top, first, count)))
        for nodes, part in units:
            if held + nodes > most:
                passes.append([])
                held = 0
            last = passes[-1][-1] if passes[-1] else None
            if part[0] is None and last and last[0] == model and last[2:] == (tree, None, None, None):
                passes[-1][-1] = (model, last[1], tree + 1, *part)
            else:
                passes[-1].append((model, tree, tree + 1, *part))
            held += nodes
    return passes


def _nodes_of(forest: Forest, asked: list[tuple]) -> pd.DataFrame:
    """The nodes of one pass; leaves that another pass of the same tree counts have path 0."""
    wanted, counted = F.lit(False), F.lit(True)
    for model, first, end, top, start, stop in asked:
        of = (F.col("model") == model) & (F.col("tree") >= first) & (F.col("tree") < end)
        if top is not None:
            own = (F.col("node") >= start) & (F.col("node") < stop)
            counted = counted & (~of | own)
            of = of & (own | (F.col("node") < top))
        wanted = wanted | of
    return forest.nodes.where(wanted).select("model", "tree", "node", "feature", "threshold", "left", F.when(counted, F.col("path")).otherwise(0.0).alias("path")).toPandas()


def score(frame: DataFrame, forest: Forest, model_col: str | None = None, name: str = "score", pass_nodes: int = PASS_NODES) -> DataFrame:
    """Add the raw score in (0, 1]; higher is more anomalous.

    The nodes are sent to the tasks in passes of at most ``pass_nodes``; each pass adds the path
    lengths of its trees. A worker keeps what it was sent for a stage, so the sums are written
    after every PASSES_AT_ONCE passes.
    """
    names = sorted({c for p in forest.params.values() for c in p.features})
    only = next(iter(forest.params))
    model = F.col(model_col).cast("string") if model_col else F.lit(only)
    values = [F.col(c).cast("double") for c in names]
    passes = _tree_passes(forest, pass_nodes)
    out = frame
    for at in range(0, len(passes), PASSES_AT_ONCE):
        if at:
            out = written(out, "path-sums")
        found = _path_sums(frame.sparkSession, forest, names, passes[at:at + PASSES_AT_ONCE])(model, *values)
        out = out.withColumn("_paths", F.col("_paths") + found if at else found)
    known = F.create_map(*[x for m, p in forest.params.items() for x in (F.lit(m), F.struct(
        F.lit(float(p.trees)).alias("trees"), F.lit(_path_scale(forest.samples[m])).alias("scale")))])
    of = F.try_element_at(known, model)
    return out.withColumn(name, F.pow(F.lit(2.0), -(F.col("_paths") / of["trees"]) / of["scale"])).drop("_paths")


def remembered(known: dict, room: int, values: np.ndarray, found: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``found(values)``, asked only for distinct rows that are not ``known``; up to ``room`` of those are added."""
    raw, width = np.ascontiguousarray(values).tobytes(), values.shape[1] * values.itemsize
    keys = [raw[at:at + width] for at in range(0, len(raw), width)]
    fresh: dict = {}
    for place, key in enumerate(keys):
        if key not in known and key not in fresh:
            fresh[key] = place
    if fresh:
        results = found(values[list(fresh.values())]).tolist()
        fresh = dict(zip(fresh, results))
        known.update(islice(fresh.items(), max(0, room)))
    return np.array([known[key] if key in known else fresh[key] for key in keys], dtype=float)


def _path_sums(spark: SparkSession, forest: Forest, names: list[str], passes: list[list[tuple]]):
    """A function of (model, values): summed path lengths in the trees of ``passes``.

    Features are mostly codes and counts, so rows repeat: a worker walks the trees once for equal rows.
    """
    shared = []
    for asked in passes:
        shared.append(spark.sparkContext.broadcast({m: pack(part) for m, part in _nodes_of(forest, asked).groupby("model")}))
    settings = {m: (_depth(forest.samples[m]), [names.index(c) for c in p.features]) for m, p in forest.params.items()}
    most = KNOWN_ROWS

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        fitted = [one.value for one in shared]
        known = fitted[0].setdefault(None, {})  # stays with the worker's copy, for its next task too
        for model, *columns in batches:
            values = np.column_stack([np.asarray(c, dtype=float) for c in columns]) if len(model) else np.empty((0, len(names)))
            out, keys = np.zeros(len(values)), model.to_numpy()
            for chosen in pd.unique(keys):
                if chosen not in settings:
                    continue
                mask = keys == chosen
                depth, places = settings[chosen]
                trees = [one[chosen] for one in fitted if chosen in one]  # a pass may have none of its trees

                def walk(rows: np.ndarray) -> np.ndarray:
                    return sum((mean_paths(flat, rows, depth) * len(flat["roots"]) for flat in trees), np.zeros(len(rows)))

                room = most - sum(map(len, known.values()))
                out[mask] = remembered(known.setdefault(chosen, {}), room, values[mask][:, places], walk)
            yield pd.Series(out)

    return run


def with_cuts(forest: Forest, scored_train: DataFrame, model_col: str | None = None, score_col: str = "score") -> Forest:
    """Fix each model's cut: 0.5, or the quantile of its training scores that leaves the
    contamination share beyond it."""
    cuts = {}
    for model, params in forest.params.items():
        if params.contamination is None:
            cuts[model] = DEFAULT_CUT
            continue
        rows = scored_train.where(F.col(model_col).cast("string") == model) if model_col else scored_train
        negated = rows.select((-F.col(score_col)).alias("_negated"))
        cuts[model] = -exact_quantiles(negated, "_negated", [params.contamination])[0]
    forest.cuts = cuts
    return forest


def train(frame: DataFrame, params: ForestParams | dict[str, ForestParams], model_col: str | None = None, key: str = "block_id",
          vocab: DataFrame | None = None) -> Forest:
    """Fit, and fix the cuts on the training rows' own scores where they are needed."""
    forest = fit(frame, params, model_col, key, vocab)
    asked = [m for m, p in forest.params.items() if p.contamination is not None]
    if asked:
        rows = frame.where(F.col(model_col).cast("string").isin(asked)) if model_col else frame
        return with_cuts(forest, written(score(rows, forest, model_col), "train_scores"), model_col)
    return with_cuts(forest, frame, model_col)


def predict(frame: DataFrame, forest: Forest, model_col: str | None = None) -> DataFrame:
    """Add ``predicted_label`` and ``anomaly_score`` (score minus cut): Anomaly iff
    strictly beyond the cut."""
    scored = score(frame, forest, model_col, "_score")
    if model_col:
        cut: Column = F.lit(None).cast("double")
        for model, value in forest.cuts.items():
            cut = F.when(F.col(model_col).cast("string") == model, F.lit(value)).otherwise(cut)
    else:
        cut = F.lit(forest.cuts[next(iter(forest.params))])
    return scored.withColumn("anomaly_score", F.col("_score") - cut).withColumn(
        "predicted_label", F.when(F.col("anomaly_score") > 0, ANOMALY).otherwise(NORMAL)).drop("_score")


def refit(forest: Forest, frame: DataFrame, vocab: DataFrame | None = None, key: str = "block_id") -> Forest:
    """The same settings on other rows."""
    return train(frame, forest.params, None, key, vocab if vocab is not None else forest.vocab)


def reseeded(params: ForestParams, seed: int) -> ForestParams:
    return replace(params, seed=seed)
