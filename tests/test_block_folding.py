"""Lines of light blocks are encoded ahead of the shuffle and folded where they lie; samples are cut without ordering the rows."""

import numpy as np
import pyarrow as pa

from loggrove.operators import blocks, sampling
from loggrove.schema import ENCODED_COLUMNS
from tests.test_block_weights import log, rows

CODES = [f"{c}_encoded" for c in ENCODED_COLUMNS]


def lines(*parts):
    """(hash, block, second, size, error, code) rows as a batch."""
    hashes, names, seconds, sizes, errors, codes = zip(*parts)
    arrays = [pa.array(names, pa.string()), pa.array([s * 1_000_000 for s in seconds], pa.int64()).view(pa.timestamp("us")), pa.array(sizes, pa.float64()),
              pa.array(errors, pa.int32()), *[pa.array(codes, pa.int32())] * len(CODES), pa.array(hashes, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["block_id", "first_seen", "block_size", "is_error", *CODES, "_hash"])


def test_blocks_that_go_on_in_later_batches_and_share_a_hash():
    data = [(1, "a", 9, 1.0, 0, 5), (1, "a", 3, 2.0, 1, 4), (2, None, 1, 0.0, 0, -1), (2, None, 2, 0.0, 0, 0), (3, "x", 7, 5.0, 0, 2), (3, "y", 6, 4.0, 1, 3),
            (3, "x", 8, 6.0, 1, 1), (3, "y", 5, 3.0, 1, 3), (3, "x", 9, 1.0, 0, 1), (4, "z", 1, 1.0, 0, 0)]
    expected = {"a": (3, 1, 2.0, 2, 4, 1), None: (1, 0, 0.0, 2, -1, 0), "x": (7, 1, 6.0, 3, 1, 1), "y": (5, 1, 4.0, 2, 3, 2), "z": (1, 0, 1.0, 1, 0, 0)}
    for step in (1, 2, 3, 4, 7, 10):
        batches = [lines(*data[at:at + step]) for at in range(0, len(data), step)] + [lines(data[0]).slice(0, 0)]
        found = [r for batch in blocks._fold_sorted(iter(batches)) for r in batch.to_pylist()]
        assert len(found) == 5
        for r in found:
            assert (r["first_seen"].second, r["is_error"], r["block_size"], r["event_frequency"], r["component_encoded"], r["error_lines"]) == expected[r["block_id"]]
            assert len({r[c] for c in CODES}) == 1


def test_codes_of_large_numbers_and_equal_counts():
    block = np.array([0, 0, 0, 0, 1, 1, 2])
    codes = np.array([2**31 - 2, 7, 7, 2**31 - 2, 3, -1, 2**31 - 2])
    assert blocks._dominant_codes(block, codes).tolist() == [7, -1, 2**31 - 2]


def test_only_encoded_lines_are_dealt_and_no_values_are_counted_apart(spark):
    plan = blocks.block_features(log(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "explode" not in plan and "MapInArrow" in plan


def test_large_vocabularies_and_small_batches_give_the_same(spark, monkeypatch):
    made = rows(blocks.block_features(log(spark), error_lines=True))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert rows(blocks.block_features(log(spark), error_lines=True)) == made
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(blocks, "fits_broadcast", lambda table: False)
    assert rows(blocks.block_features(log(spark), error_lines=True)) == made == rows(blocks.block_features(log(spark), light=5, error_lines=True))


def test_blocks_are_counted_alone_only_in_full_buckets(spark):
    assert blocks._heavy_blocks(log(spark), 1000) is None
    heavy = blocks._heavy_blocks(log(spark), 20)
    sizes = {r["block_id"]: r["count"] for r in log(spark).where("datetime is not null").groupBy("block_id").count().collect()}
    assert {r["_heavy"] for r in heavy.collect()} == {b for b, n in sizes.items() if n > 20} and heavy.count()


def test_samples_are_cut_without_ordering_rows(spark, monkeypatch):
    made = spark.range(5000).selectExpr("concat('b', id) as block_id", "if(id % 10 = 0, 'Anomaly', 'Normal') as label")
    ranks = {r["block_id"]: (r["label"], r["_rank"]) for r in sampling._class_ranks(made, 42, "label", "block_id").collect()}
    monkeypatch.setattr(sampling, "ranked", None)
    sample = {r["block_id"] for r in sampling.stratified_sample(made, 405).collect()}
    assert sample == {b for b, (label, rank) in ranks.items() if rank <= {"Anomaly": 41, "Normal": 365}[label]}
