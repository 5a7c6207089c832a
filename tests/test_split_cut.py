"""Splits are cut by a row's random order without ordering the rows."""

from loggrove.operators import sampling


def test_splits_are_cut_without_ordering_rows(spark, monkeypatch):
    made = spark.range(5000).selectExpr("concat('b', id) as block_id", "case when id % 10 = 0 then 'Anomaly' when id % 101 = 1 then null else 'Normal' end as label")
    ranks = {(r["block_id"]): r["_rank"] for r in sampling._class_ranks(made.where("label is not null"), 42, "label", "block_id").collect()}
    sizes = dict(sampling._class_sizes(made.where("label is not null"), "label"))
    monkeypatch.setattr(sampling, "ranked", None)
    for share in (0.0, 0.0004, 0.3, 0.5, 1.0):
        split = sampling.stratified_split(made, share).collect()
        assert len(split) == 5000
        for r in split:
            wanted = r["label"] is not None and ranks[r["block_id"]] <= int(share * sizes[r["label"]] + 0.5)
            assert r["split"] == ("test" if wanted else "train")


def test_repeated_keys_across_the_end_are_ranked(spark):
    made = spark.createDataFrame([("same", "Normal")] * 10 + [(None, "Anomaly")] * 4, "block_id string, label string")
    split = sampling.stratified_split(made, 0.5)
    assert sorted((r["label"], r["split"]) for r in split.select("label", "split").collect()) == (
        [("Anomaly", "test")] * 2 + [("Anomaly", "train")] * 2 + [("Normal", "test")] * 5 + [("Normal", "train")] * 5)
