"""Trees of a share of all rows, however many, grown from counts of equal rows and in pieces."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loggrove.operators import forest as forests
from loggrove.operators.forest import ForestParams
from loggrove.plans import training
from loggrove.queries import models
from loggrove.scratch import scratch_path

FEATURES = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 3000
    table = pd.DataFrame({"block_id": [f"b{i}" for i in range(n)], "a": rng.normal(size=n), "b": rng.integers(0, 40, n).astype(float), "c": rng.exponential(size=n).round(1)})
    table.loc[:30, "c"] = np.nan
    return spark.createDataFrame(table).withColumn("label", F.when(F.col("a") > 2, "Anomaly").otherwise("Normal")).persist()


@pytest.fixture
def small_tasks(monkeypatch):
    """Trees are large, and grown in pieces, from few rows on."""
    monkeypatch.setattr(forests, "TREE_ROWS", 100)
    monkeypatch.setattr(forests, "TASK_ROWS", 60)


def trees_of(forest):
    nodes = forest.nodes.toPandas().sort_values(["model", "tree", "node"])
    return {key: part.reset_index(drop=True) for key, part in nodes.groupby(["model", "tree"])}


def leaf_of(tree, values):
    node = 0
    while tree["feature"][node] >= 0:
        node = tree["left"][node] if values[tree["feature"][node]] <= tree["threshold"][node] else tree["right"][node]
    return node


def test_a_share_can_be_one_of_all_rows():
    assert ForestParams(rows_per_tree=0.5, share_of=None).sample_rows(10**9) == 5 * 10**8
    assert ForestParams(share_of=None).sample_rows(10**9) == forests.DEFAULT_ROWS  # a count stays one


@pytest.mark.parametrize("query", [models.version_summary_over_seeds, models.versions_over_split_seeds])
def test_versions_are_fitted_on_shares_of_all_training_rows(monkeypatch, query):
    asked = []
    monkeypatch.setattr(models, "labeled_orders", lambda spark, folder: None)
    monkeypatch.setattr(training, "compare_versions", lambda blocks, versions, seeds: asked.append(versions))
    monkeypatch.setattr(training, "version_summary", lambda per_seed: None)
    query(None, "")
    assert {v: p.sample_rows(10**8) for v, p in asked[0].items()} == {"v1": 256, "v2": 2 * 10**7}


def test_repeats_of_draws_add_up(monkeypatch):
    monkeypatch.setattr(forests, "REPEATS_AT_ONCE", 300)
    found = forests.repeat_counts(1000, 1000, np.random.default_rng(0))
    assert sum(times * count for times, count in enumerate(found, 1)) == 1000 and 600 < sum(found) < 660
    assert forests.repeat_counts(5, 1, np.random.default_rng(0)) == [0, 0, 0, 0, 1]


@pytest.mark.parametrize("bootstrap", [False, True])
def test_large_trees_hold_the_rows_drawn_for_them(spark, rows, small_tasks, monkeypatch, bootstrap):
    kept, drawn = [], forests._drawn_rows
    monkeypatch.setattr(forests, "_drawn_rows", lambda *given: kept.append(drawn(*given)) or kept[0])
    params = ForestParams(trees=7, rows_per_tree=0.3, feature_share=0.7, bootstrap=bootstrap, features=FEATURES, share_of=None)
    forest = forests.fit(rows, params)
    sample, trees = kept[0].toPandas(), trees_of(forest)
    assert len(trees) == 7 and forest.samples == {"model": 900} and len(forest.parts) > 0
    for (_, number), tree in trees.items():
        own = sample[sample["slot"] == number]
        inner = tree["feature"] >= 0
        assert tree["node"].tolist() == [*range(len(tree))] and tree["rows"][0] == own["times"].sum() == 900
        assert (tree["right"][inner] == tree["left"][inner] + 1).all()
        assert (tree["rows"][tree["left"][inner]].to_numpy() + tree["rows"][tree["right"][inner]].to_numpy() == tree["rows"][inner].to_numpy()).all()
        assert sorted([0, *tree["left"][inner], *tree["right"][inner]]) == [*range(len(tree))]
        assert tree.loc[inner, "feature"].nunique() == 2  # of three, at a share of 0.7
        counted, depth = np.zeros(len(tree)), np.zeros(len(tree))
        for values, times in zip(own[list(FEATURES)].to_numpy(), own["times"]):
            counted[leaf_of(tree, values)] += times
        assert (counted[~inner] == tree["rows"][~inner]).all()
        for node in np.flatnonzero(inner):
            depth[[tree["left"][node], tree["right"][node]]] = depth[node] + 1
        assert depth.max() <= 10 and np.allclose(tree["path"], depth + forests.average_path(tree["rows"]))
        # Every leaf that is not at the last level holds rows that cannot be told apart.
        at = pd.Series([leaf_of(tree, v) for v in own[list(FEATURES)].to_numpy()])
        crowded = at[at.duplicated()].unique()
        for node in crowded:
            held = own[list(FEATURES)].to_numpy()[(at == node).to_numpy()]
            assert depth[node] == 10 or not (held.max(axis=0) > held.min(axis=0)).any()
    if not bootstrap:  # the trees of a pass share no row, and a row is a tree's own once
        assert (sample.groupby("slot")["times"].sum() == 900).all()


def test_rows_of_equal_keys_are_dealt_exactly(spark, small_tasks):
    """A boundary between trees may fall among rows without a key, or of one key."""
    frame = spark.range(1000).selectExpr("if(id < 400, null, if(id < 800, 'same', cast(id as string))) as block_id", "cast(id as double) as a")
    forest = forests.fit(frame, ForestParams(trees=4, rows_per_tree=0.25, features=("a",), share_of=None))
    assert [tree["rows"][0] for tree in trees_of(forest).values()] == [250] * 4
    assert all(tree["threshold"].max() < 1000 for tree in trees_of(forest).values())


def test_large_trees_do_not_depend_on_partitions(spark, rows, small_tasks):
    params = ForestParams(trees=4, rows_per_tree=0.2, bootstrap=True, features=FEATURES, share_of=None)
    first, second = (trees_of(forests.fit(frame, params)) for frame in (rows, rows.repartition(7, "b")))
    for key, tree in first.items():
        pd.testing.assert_frame_equal(tree, second[key])


def test_large_trees_are_scored_in_parts(spark, rows, small_tasks):
    """Passes smaller than a tree give the scores of whole trees, also after a save."""
    params = {"few": ForestParams(trees=3, rows_per_tree=20, features=("a",)), "many": ForestParams(trees=3, rows_per_tree=0.3, features=FEATURES, share_of=None)}
    both = rows.withColumn("m", F.lit("few")).unionByName(rows.withColumn("m", F.lit("many")))
    forest = forests.fit(both, params, "m")
    assert set(forest.parts) == {("many", tree) for tree in range(3)}
    passes = forests._tree_passes(forest, 200)
    assert any(unit[3] is not None for units in passes for unit in units)
    path = scratch_path(spark, "saved")
    forest.save(path)
    again = forests.Forest.load(spark, path)
    assert again.parts == forest.parts and again.params == forest.params
    scores = [{(r["m"], r["block_id"]): r["score"] for r in forests.score(both, f, "m", pass_nodes=n).collect()} for f, n in ((forest, 10**6), (again, 200))]
    assert len(scores[0]) == 6000 and scores[0] == pytest.approx(scores[1], abs=1e-12)
    trees = trees_of(forest)
    for r in rows.limit(20).collect():
        values = np.array([r[c] for c in FEATURES], dtype=float)
        path_of = np.mean([trees["many", t]["path"][leaf_of(trees["many", t], values)] for t in range(3)])
        assert scores[0]["many", r["block_id"]] == pytest.approx(float(forests.scores_from_paths(np.array([path_of]), 900)[0]))


def test_outliers_score_higher_with_large_trees(spark, rows, small_tasks):
    from loggrove.operators import metrics

    params = ForestParams(trees=30, rows_per_tree=0.5, contamination=0.03, bootstrap=True, features=("a",), share_of=None)
    found = metrics.evaluate(forests.predict(rows, forests.train(rows, params)), (), "label").first()
    assert found["recall"] > 0.4 and abs(found["tp"] + found["fp"] - 90) <= 5
