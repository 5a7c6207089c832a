import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loggrove.operators import forest as forests, metrics, search
from loggrove.operators.forest import ForestParams
from loggrove.operators.reconstruction import fit_reconstruction
from loggrove.operators.retention import Normalizer, block_table, evaluate_policy, keep_or_drop, outcome
from loggrove.plans import lineage, training, uploads
from loggrove.schema import TRAINING_FEATURES
from loggrove.scratch import scratch_path

SCHEMA = "block_id string, label string, " + ", ".join(f"{c} double" for c in TRAINING_FEATURES)


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(1)
    values = np.vstack([rng.normal(0, 1, (360, 7)), rng.normal(8, 1, (40, 7))])
    rows = [(f"b{i:03d}", "Anomaly" if i >= 360 else "Normal", *map(float, v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA).persist()


def test_tree_shape_and_path_lengths():
    rng = np.random.default_rng(0)
    values = rng.normal(size=(256, 5))
    tree = forests.grow_tree(values, 1.0, rng)
    inner = tree["feature"] >= 0
    assert (tree["rows"][tree["left"][inner]] + tree["rows"][tree["right"][inner]] == tree["rows"][inner]).all()
    assert tree["rows"][~inner].sum() == 256 and tree["rows"][0] == 256
    assert np.allclose(forests.average_path([1, 2, 256]), [0.0, 1.0, 2 * (np.log(255) + np.euler_gamma) - 2 * 255 / 256])
    flat = np.repeat([[1.0, 2.0]], 50, axis=0)
    assert len(forests.grow_tree(flat, 1.0, rng)["rows"]) == 1  # nothing to split


def test_scoring_walks_every_tree(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    values = rng.normal(size=(100, 3))
    trees = [forests.grow_tree(values[rng.permutation(100)[:32]], 1.0, rng) for _ in range(5)]
    flat = forests.pack(pd.concat([pd.DataFrame({**t, "tree": i, "node": np.arange(len(t["rows"]))}) for i, t in enumerate(trees)]))
    fast = forests.mean_paths(flat, values, 5, batch=17)
    for row, found in zip(values, fast):
        paths = []
        for t in trees:
            node = 0
            while t["feature"][node] >= 0:
                node = t["left"][node] if row[t["feature"][node]] <= t["threshold"][node] else t["right"][node]
            paths.append(t["path"][node])
        assert found == pytest.approx(np.mean(paths))


def test_outliers_score_higher_and_partitions_do_not_matter(spark, blocks):
    params = ForestParams(trees=40, contamination=0.1)
    first = forests.predict(blocks, forests.train(blocks, params))
    second = forests.predict(blocks, forests.train(blocks.repartition(1), params))
    scores = [{r["block_id"]: r["anomaly_score"] for r in frame.collect()} for frame in (first, second)]
    assert scores[0] == pytest.approx(scores[1])
    row = metrics.evaluate(first, (), "label").first()
    assert row["f1"] > 0.9 and row["tp"] + row["fp"] == 40


def test_every_tree_gets_its_rows(spark, blocks):
    model = forests.fit(blocks, ForestParams(trees=7, rows_per_tree=0.3))
    leaves = model.nodes.where("feature < 0").groupBy("tree").agg(F.sum("rows").alias("n")).collect()
    assert sorted(r["tree"] for r in leaves) == list(range(7)) and {r["n"] for r in leaves} == {120}


def test_bootstrap_repeats_rows():
    rng = np.random.default_rng(0)
    drawn = forests.resample(np.arange(1000)[:, None], 1000, rng)
    assert len(drawn) == 1000 and 600 < len(np.unique(drawn)) < 660


def test_models_round_trip_and_vocabulary_rules(spark, blocks, tmp_path):
    vocab = spark.createDataFrame([("component", "a", 0)], "column string, value string, code int")
    model = forests.train(blocks, ForestParams(trees=10, contamination=0.1), vocab=vocab)
    path = scratch_path(spark, "saved")
    model.save(path)
    again = forests.Forest.load(spark, path)
    assert again.params == model.params and again.cuts == pytest.approx(model.cuts) and again.vocab.count() == 1
    same = lambda m: {r["block_id"]: r["anomaly_score"] for r in forests.predict(blocks, m).collect()}
    assert same(again) == pytest.approx(same(model))
    structured = spark.createDataFrame([], "date string, block_id string")
    with pytest.raises(ValueError, match="no vocabulary"):
        uploads.score_upload(structured, "hdfs", model, None)
    model.vocab = None
    with pytest.raises(ValueError, match="no vocabulary"):
        uploads.score_upload(structured, "hdfs", model, vocab)


def test_search_finds_a_good_forest(spark, blocks):
    best, result = search.search_forest(blocks, population=6, generations=2, parents=3)
    assert result.best_fitness > 0.8 and best.features and len(result.history) == 2 and result.history == sorted(result.history)
    again = search.search_forest(blocks.repartition(2), population=6, generations=2, parents=3)[1]
    assert again.best_genes == result.best_genes
    scores = search.score_candidates(blocks, [None, ForestParams(trees=20, contamination=0.1)]).orderBy("candidate").collect()
    assert scores[0]["mean_f1"] == 0.0 and scores[1]["mean_f1"] > 0.8


def test_policy_decoding_always_orders_the_thresholds():
    policy = search.decode_policy([0, 0, 0, 0.4, 1.0, 0.9]).validate()
    assert policy.t_warm < policy.t_hot == 0.4 and policy.weights == pytest.approx((1 / 3, 1 / 3, 1 / 3)) and policy.summary_fraction == 0.5
    assert search.decode_forest([0] * 7 + [100, 0.5, 0.5, 0.1, 0]) is None


def test_searched_policy_beats_keeping_everything(spark, blocks):
    model = forests.train(blocks, ForestParams(trees=30, contamination=0.1))
    scored = forests.predict(blocks, model).select(
        "block_id", "anomaly_score", "predicted_label", F.col("label").alias("true_label"), F.lit(20).alias("event_frequency"),
        F.lit(10.0).alias("block_size"), F.lit(0).alias("is_error"))
    table = block_table(scored, Normalizer.fit(scored))
    best, result = search.search_policy(table, population=16, generations=5, parents=6)
    found = evaluate_policy(table, best).first()
    everything = outcome(keep_or_drop(table, F.lit(True))).first()
    assert found["fitness"] == pytest.approx(result.best_fitness) and found["fitness"] > everything["fitness"] == 0.0


def test_reconstruction_separates_outliers(spark, blocks):
    normal = blocks.where("label = 'Normal'")
    scored = fit_reconstruction(normal, TRAINING_FEATURES).score(blocks)
    area = metrics.roc_auc(scored, ["reconstruction_error"], F.col("label") == "Anomaly").first()["auc"]
    assert area > 0.95


def test_version_comparison(spark, blocks):
    out = training.compare_versions(blocks, {"v1": ForestParams(trees=20), "v2": ForestParams(trees=20, contamination=0.1)}, [1, 2])
    rows = out.collect()
    assert len(rows) == 4 and sum(r["wins"] for r in rows) == 2
    summary = {r["version"]: r for r in training.version_summary(out).collect()}
    assert summary["v2"]["test_f1_mean"] > 0.8 and summary["v2"]["seeds"] == 2


def test_lineage(spark):
    import time

    history = spark.createDataFrame([], lineage.HISTORY_SCHEMA)

    def add(row):
        nonlocal history
        time.sleep(0.01)
        path = scratch_path(spark, "history")
        history.unionByName(row).write.parquet(path)
        history = spark.read.schema(lineage.HISTORY_SCHEMA).parquet(path)

    add(lineage.decision_row(spark, history, 0.5, 0.5))            # equal is not better
    assert lineage.live_version(history).first()["version"] == 1
    add(lineage.decision_row(spark, history, 0.5, 0.6))
    add(lineage.decision_row(spark, history, 0.6, 0.7))
    assert lineage.live_version(history).first()["version"] == 3
    add(lineage.override_row(spark, history, 2, "v3 misbehaves"))
    assert lineage.live_version(history).first()["version"] == 2 and lineage.next_version(history).first()["next_version"] == 4
    assert {r["version"]: r["status"] for r in lineage.version_table(history).collect()} == {1: "retired", 2: "active", 3: "rolled_back"}
    add(lineage.decision_row(spark, history, 0.6, 0.65))
    assert lineage.live_version(history).first()["version"] == 4  # never reuses 3
    add(lineage.override_row(spark, history, 3, "wins held-out", "manual_promotion"))
    assert lineage.live_version(history).first()["version"] == 3
    with pytest.raises(ValueError, match="never issued"):
        lineage.override_row(spark, history, 9, "x")
    states = spark.createDataFrame([(False, 0.9), (True, None), (True, 0.39), (True, 0.4)], "e boolean, f double")
    assert [r[0] for r in states.select(lineage.health(F.col("e"), F.col("f"))).collect()] == ["unavailable", "unverified", "degraded", "healthy"]


def test_retrain_applies_feedback_and_appends_history(spark, blocks):
    incumbent = forests.train(blocks, ForestParams(trees=10))
    feedback = blocks.where("label = 'Normal'").limit(3).select(
        F.lit("s").alias("source"), "block_id", F.lit("anomaly").alias("verdict"), F.current_timestamp().cast("timestamp_ntz").alias("at"))
    history = spark.createDataFrame([], lineage.HISTORY_SCHEMA)
    done = training.retrain(spark, blocks, feedback, incumbent, 0.1, history, population=4, generations=1, parents=2)
    assert done["applied"] == 3 and done["incumbent_f1"] != 0.1 and done["history"].count() == 1
    row = done["history"].first()
    assert row["promoted"] == (done["candidate_f1"] > done["incumbent_f1"])


def test_a_share_of_many_rows_is_a_share_of_a_bounded_sample():
    params = ForestParams(rows_per_tree=0.5, share_of=1000)
    assert params.sample_rows(100) == 50 and params.sample_rows(10**9) == 500
    assert ForestParams(rows_per_tree=1.0).sample_rows(10**9) == forests.SHARE_OF


def test_scores_do_not_depend_on_the_number_of_passes(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("block_id"), *[
        (F.xxhash64("id", F.lit(c)) % 50).cast("double").alias(c) for c in ("a", "b")])
    forest = forests.fit(rows, ForestParams(trees=7, rows_per_tree=0.2, share_of=100, features=("a", "b")))
    once, often = (forests.score(rows, forest, pass_nodes=n) for n in (10**6, 90))
    assert len(forests._tree_passes(forest, 90)) > 2
    pairs = once.join(often.select("block_id", F.col("score").alias("again")), "block_id")
    assert pairs.where(F.abs(F.col("score") - F.col("again")) > 1e-12).isEmpty() and pairs.count() == 300


@pytest.mark.parametrize("folds", [1, 3])
def test_candidates_equal_forests_grown_one_after_another(spark, blocks, folds):
    """F1 of every candidate and fold as by growing its trees in a row on the same sample."""
    candidates = [ForestParams(trees=23, rows_per_tree=0.5, contamination=0.1, feature_share=0.8), None,
                  ForestParams(trees=10, rows_per_tree=64, bootstrap=True, contamination=0.05, features=TRAINING_FEATURES[:3], seed=9)]
    frame = blocks.withColumn("fold", F.pmod(F.xxhash64("block_id"), F.lit(folds)).cast("int"))
    found = {r["candidate"]: r for r in search.score_candidates(frame, candidates, folds).collect()}
    names = list(TRAINING_FEATURES)
    rows = frame.select(*[F.col(c).cast("double").alias(c) for c in names], (F.col("label") == "Anomaly").alias("y"), "fold").toPandas()
    rows = rows.sort_values([*names, "y", "fold"])
    fold, y = rows["fold"].to_numpy(), rows["y"].to_numpy()
    for number, params in enumerate(candidates):
        if params is None:
            assert found[number]["mean_f1"] == 0
            continue
        values, scores = rows[list(params.features)].to_numpy(float), []
        for f in range(folds):
            test = fold == f if folds > 1 else np.ones(len(y), bool)
            train = ~test if folds > 1 else test
            fitted, parts = values[train], []
            sample = params.sample_rows(len(fitted))
            for tree in range(params.trees):
                rng = np.random.default_rng([params.seed, tree])
                own = fitted[rng.integers(0, len(fitted), sample)] if params.bootstrap else fitted[rng.permutation(len(fitted))[:sample]]
                grown = forests.grow_tree(own, params.feature_share, rng)
                parts.append(pd.DataFrame({**grown, "tree": tree, "node": np.arange(len(grown["rows"]))}))
            paths = forests.mean_paths(forests.pack(pd.concat(parts)), values, forests._depth(sample))
            score = forests.scores_from_paths(paths, sample)
            flagged = score > -np.quantile(-score[train], params.contamination)
            hit = (flagged & y & test).sum()
            scores.append(2 * hit / ((flagged & test).sum() + (y & test).sum()) if hit else 0.0)
        assert abs(found[number]["mean_f1"] - np.mean(scores)) < 0.02 and abs(found[number]["std_f1"] - np.std(scores)) < 0.02


def test_overrides_of_many_histories(spark):
    """Moves to issued versions become events; others, and unknown kinds, do not."""
    columns = "source string, at timestamp, event string, promoted boolean, from_version int, to_version int, new_version int, candidate_value double"
    moment = lambda d: datetime.datetime(2024, 1, d)
    past = spark.createDataFrame([
        ("a", moment(1), "decision", True, 1, 2, 2, 0.9), ("a", moment(2), "decision", True, 2, 3, 3, 0.5),
        ("b", moment(1), "decision", False, 1, 1, None, 0.1)], columns)
    asked = spark.createDataFrame([
        ("a", moment(3), "rollback", 2, "worse"), ("a", moment(4), "rollback", 9, "never issued"), ("b", moment(3), "manual_promotion", 1, "first"),
        ("b", moment(3), "other", 1, "no such kind"), ("c", moment(3), "rollback", 1, "no history")],
        "source string, at timestamp, event string, to_version int, reason string")
    events = lineage.overrides(past, asked, ["source"])
    assert sorted((r["source"], r["event"], r["from_version"], r["to_version"], r["reason"]) for r in events.collect()) == [
        ("a", "rollback", 3, 2, "worse"), ("b", "manual_promotion", 1, 1, "first")]
    live = lineage.live_version(past.unionByName(events.drop("reason")), ["source"])
    assert {r["source"]: r["version"] for r in live.collect()} == {"a": 2, "b": 1}
    assert lineage.overrides(past, asked.where("false"), ["source"]).count() == 0
