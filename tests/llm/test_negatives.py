import random

import numpy as np
import pytest

from common import crowded, rows
from loggrove.llm import negatives

ROW = "vec_id long, embedding array<float>, label int"


def plain(data, every=100):
    """The result by scoring all pairs with Python's integers."""
    taken = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in data
             if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, label in taken:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in taken if j != i]
        for score, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fits = sorted((s, k) for s, k, other in scored if other != label and 30 * -score <= 100 * -s <= 90 * -score)
            out += [(i, j, rank, k, -score, -s) for rank, (s, k) in enumerate(fits[:10], 1)]
    return sorted(out, key=repr)


def vectors(n, size, spread, seed=3, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    out = []
    for i in range(n):
        v = centres[i % 6] + spread * rng.normal(size=size)
        out.append((i, [float(np.float32(x)) for x in scale * v / np.linalg.norm(v)], int(rng.integers(0, 6)) if i % 4 == 0 else i % 6))
    return out


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("size, spread, scale", [(16, 0.3, 1.0), (8, 1.5, 1.0), (5, 0.5, 3000.0), (3, 0.2, 4e6)])
def test_equals_scoring_all_pairs(spark, size, spread, scale):
    data = vectors(700, size, spread, scale=scale)
    frame = crowded(spark.createDataFrame(data, ROW)).repartition(5)
    found = negatives.hard_negatives(negatives.valid_rows(frame), every=20)
    assert tuple(found.columns) == COLUMNS
    wanted = plain(data, every=20)
    assert rows(found, *COLUMNS) == wanted and len(wanted) > 500


def test_anchors_in_passes_and_one_hot_label(spark, spread):
    data = [(i, v, 0 if i % 3 else label) for i, v, label in vectors(600, 12, 0.4)]
    found = negatives.hard_negatives(negatives.valid_rows(spark.createDataFrame(data, ROW)), every=10, pass_bytes=8 * 12 * 7)
    assert rows(found, *COLUMNS) == plain(data, every=10)


def test_rows_that_take_no_part(spark):
    data = vectors(300, 6, 0.5)
    nan, inf = float("nan"), float("inf")
    odd = [(None, data[0][1], 1), (1000, None, 1), (1001, [nan] * 6, 2), (1002, [inf] + [0.0] * 5, 2), (1003, [None] + [0.1] * 5, 1), (1004, data[3][1], None),
           (1100, [0.0] * 6, 1), (1200, [], 2), (1300, [1.0, 0.5], 3), (1005, [], 3)]
    found = negatives.hard_negatives(negatives.valid_rows(spark.createDataFrame(data + odd, ROW)))
    assert rows(found, *COLUMNS) == plain(data + odd)
    huge = [(2000, [1e30] * 6, 1)]
    assert rows(negatives.hard_negatives(negatives.valid_rows(spark.createDataFrame(data + huge, ROW))), *COLUMNS) == plain(data)


def test_ties_and_repeated_rows(spark):
    random.seed(2)
    data = [(i, random.choice([[1.0, 0.0], [0.5, 0.5], [0.25, 0.0], [-1.0, 0.0]]), i % 3) for i in range(200)]
    assert rows(negatives.hard_negatives(negatives.valid_rows(spark.createDataFrame(data, ROW)), every=10), *COLUMNS) == plain(data, every=10)
    twice = data + data[:50]
    assert rows(negatives.hard_negatives(negatives.valid_rows(spark.createDataFrame(twice, ROW)), every=10), *COLUMNS) == plain(twice, every=10)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROW)
    assert negatives.hard_negatives(negatives.valid_rows(none)).count() == 0
    assert negatives.hard_negatives(negatives.valid_rows(spark.createDataFrame([(1, [1.0], 1)], ROW))).count() == 0
    assert negatives.hard_negatives(negatives.valid_rows(spark.createDataFrame([(100, [], 1)], ROW))).count() == 0


def test_bounds_hold_and_rule_blocks_out():
    """Every true score lies between a block's bounds, and narrow blocks are ruled out for far anchors."""
    rng = np.random.default_rng(1)
    rows_ = np.floor(256 * (np.array([1.0, 0, 0, 0]) + 0.05 * rng.normal(size=(200, 4))))
    anchors = np.floor(256 * rng.normal(size=(300, 4)))
    directions = negatives.farthest(np.concatenate([rows_, anchors]), 8)
    measures = np.column_stack([negatives.angles_to(rows_, directions), np.linalg.norm(rows_, axis=1)])
    own = negatives.Anchors(np.arange(300), np.zeros(300), anchors.astype(np.int32), directions)
    least, most = own.bounds(measures.min(axis=0), measures.max(axis=0))
    scores = anchors @ rows_.T
    assert (least <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most).all()
    assert (most < 0).mean() > 0.2
