"""Blocks share the state of a bucket, and large ones keep theirs in pages: the same results either way."""

import pytest
from pyspark.sql import functions as F

from loggrove.operators.blocks import block_features
from loggrove.schema import FEATURE_COLUMNS
from loggrove.streaming import blocks as stream_blocks
from test_streaming import Run, line

LINES = [line(7 * i % 40, f"blk_{i % 5 if i % 2 else 0}", f"Receiving block {{}} src: /10.0.0.{i % 9}:1 dest: /10.0.0.{i % 4}:2", "WARN" if i % 7 == 0 else "INFO")
         for i in range(60)]


@pytest.mark.parametrize("buckets,page", [(1, 2), (2, 1000), (64, 3)])
def test_buckets_and_pages(spark, tmp_path, monkeypatch, buckets, page):
    made = stream_blocks.block_stream
    monkeypatch.setattr(stream_blocks, "block_stream", lambda *args, **options: made(*args, **options, buckets=buckets, page=page))
    late = [line(5000, "blk_9"), line(5001, "blk_9")]
    run = Run(spark, tmp_path, [LINES[:25], LINES[20:50], LINES, late[:1], late[1:]], (2, 3, 50), 4000)
    columns = ["block_id", *FEATURE_COLUMNS]
    expected = {tuple(r) for r in block_features(run.batch, run.vocab).select(columns).collect()}
    ended = {tuple(r) for r in run.out.where("kind = 'final'").select(columns).collect()}
    opened = {tuple(r) for r in run.open.select(columns).collect()}
    assert ended | opened == expected and len(ended) == 5 and {r[0] for r in opened} == {"blk_9"}
    assert run.count("accepted") == run.batch.count() and run.count("accepted") + run.count("duplicates") == 25 + 30 + 60 + 2
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "blocks").load()
    assert state.count() <= buckets  # one value for all blocks of a bucket
    pages = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "pages").load()
    assert pages.where("user_map_key.block_id != 'blk_9'").isEmpty()  # an ended block leaves none


def test_an_open_block_in_pages(spark, tmp_path, monkeypatch):
    made = stream_blocks.block_stream
    monkeypatch.setattr(stream_blocks, "block_stream", lambda *args, **options: made(*args, **options, buckets=2, page=3))
    run = Run(spark, tmp_path, [LINES[:25], LINES[20:50], LINES], (2, 3), None)
    columns = ["block_id", *FEATURE_COLUMNS]
    assert {tuple(r) for r in run.open.select(columns).collect()} == {tuple(r) for r in block_features(run.batch, run.vocab).select(columns).collect()}
    pages = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "pages").load()
    assert pages.select(F.col("user_map_key.name")).distinct().count() == 2
