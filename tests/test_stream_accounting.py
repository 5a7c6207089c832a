import dataclasses
import json
import os

import pytest
from pyspark.sql import functions as F

from loggrove.operators.clean import clean, known, recognized
from loggrove.operators.vocab import append_codes
from loggrove.schema import ENCODED_COLUMNS
from loggrove.scratch import written
from loggrove.sources.lines import read_lines, stream_lines
from loggrove.sources.registry import parse
from loggrove.streaming import blocks as stream_blocks
from loggrove.streaming import jobs
from test_streaming import FINAL, SNAPSHOT, batch, line, models  # noqa: F401

OLD = "080901 200000 145 INFO dfs.A: Receiving block {} src: /10.0.0.1:1 dest: /10.0.0.2:2"  # over 60 days before the others


def test_every_line_is_counted_once_however_late(spark, tmp_path):
    deliveries = [
        [line(0, "blk_1"), line(0, "blk_1"), "no log line", "", line(1, "blk_2", "a line without a block".replace("{}", ""))],
        [line(500, "blk_3")],
        [line(501, "blk_3")],                                             # closes blk_1
        [OLD.format("blk_1"), OLD.format("blk_4"), line(502, "blk_3", "Served block {} to /10.0.0.7")],
        [line(503, "blk_3"), "still none"],
    ]
    source = str(tmp_path / "in")
    os.makedirs(source)
    for i, lines in enumerate(deliveries):
        path = os.path.join(source, f"{i}.log")
        with open(path, "w", encoding="utf-8") as handle:
            handle.write("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    known_part = parse(read_lines(spark, os.path.join(source, "0.log")), "hdfs")
    vocab = written(append_codes(clean(recognized(known_part)).select(
        "arrival_chunk", "arrival_seq", *[known(F.col(c)).alias(c) for c in ENCODED_COLUMNS])), "vocab")
    events = stream_blocks.encoded_events(stream_lines(spark, source, 1), "hdfs", vocab, rejects=True)
    stream_blocks.block_stream(events, "hdfs", (2, 3), timeout_seconds=100, vocab=vocab).writeStream.format("memory").queryName("counted").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    counts = spark.table("counted").where("kind = 'counts'")
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in jobs.COUNTS]).first().asDict()
    assert {c: totals[c] for c in ("accepted", "duplicates", "late", "rejected")} == {"accepted": 6, "duplicates": 1, "late": 1, "rejected": 4}
    assert sum(totals[c] for c in ("accepted", "duplicates", "late", "rejected")) == sum(map(len, deliveries))
    assert totals["unseen_event_type"] == 1 and totals["unseen_component"] == 0
    old = counts.where("block_id = 'blk_4'").first()
    assert old["accepted"] == 1
    opened = stream_blocks.open_blocks(spark, str(tmp_path / "state"))
    assert opened.where(F.col("block_id").startswith(stream_blocks.REJECTED)).isEmpty()  # rejected lines keep no state
    ended = spark.table("counted").where("kind = 'final' and block_id = 'blk_1'").collect()
    assert [r["event_frequency"] for r in ended] == [1]


def test_snapshots_bring_the_earlier_ones_along(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    for i in range(2):
        path = tmp_path / "in" / f"{i}.log"
        path.write_text("\n".join(line(3 * i + j, "blk_1") for j in range(3)) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    vocab = spark.createDataFrame([("component", "dfs.A", 0)], "column string, value string, code int")
    events = stream_blocks.encoded_events(stream_lines(spark, str(tmp_path / "in"), 1), "hdfs", vocab)
    stream_blocks.block_stream(events, "hdfs", (2, 3, 5), timeout_seconds=None).writeStream.format("memory").queryName("brought").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = {r["k"]: [json.loads(e)["k"] for e in r["earlier"]] for r in spark.table("brought").where("kind = 'snapshot'").collect()}
    assert found == {2: [], 3: [2], 5: [2, 3]}


@pytest.mark.parametrize("third,told", [(0.0, []), (2.0, [5])])
def test_a_later_batch_knows_what_an_earlier_one_fired(spark, tmp_path, models, third, told):  # noqa: F811
    """The alerts of the run are not read: none has been written here."""
    scorer = dataclasses.replace(models, thresholds={3: third, 5: 0.0})
    before = json.dumps({**{k: v for k, v in SNAPSHOT.items() if k != "kind"}, "k": 3, "type_counts": {"a": 3}})
    rows = batch(spark, {**SNAPSHOT, "block_id": "b", "k": 5, "earlier": [before]}, {**SNAPSHOT, "block_id": "c", "k": 5, "earlier": []})
    jobs.write_outputs(rows, scorer, "one", str(tmp_path / "out"), 1)
    alerts = jobs.read_outputs(spark, str(tmp_path / "out"))["alerts"].where("block_id = 'b'").collect()
    assert [r["k"] for r in alerts] == told
    assert jobs.read_outputs(spark, str(tmp_path / "out"))["alerts"].where("block_id = 'c'").count() == 1


def test_a_batch_is_read_once_its_counts_are_there(spark, tmp_path, models):  # noqa: F811
    out = str(tmp_path / "out")
    counts = {"kind": "counts", "block_id": "b", "accepted": 3, "duplicates": 1, "late": 2, "rejected": 5}
    first = batch(spark, {**FINAL, "block_id": "a"}, counts)
    second = batch(spark, {**FINAL, "block_id": "b"}, counts)
    jobs.write_outputs(first, models, "one", out, 0)
    jobs.decisions(second, models, "one").write.parquet(f"{out}/decisions/run=one/epoch=1")  # the driver is lost after this
    assert [r["block_id"] for r in jobs.read_outputs(spark, out)["decisions"].collect()] == ["a"]
    jobs.write_outputs(second, models, "one", out, 1)                                        # the batch runs again
    tables = jobs.read_outputs(spark, out)
    assert sorted(r["block_id"] for r in tables["decisions"].collect()) == ["a", "b"]
    status = jobs.run_status(tables["alerts"], tables["decisions"], tables["counts"]).first()
    assert (status["accepted"], status["duplicates"], status["late"], status["rejected"]) == (6, 2, 4, 10)
