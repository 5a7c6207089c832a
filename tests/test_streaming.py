import os

import pytest
from pyspark.sql import functions as F

from loggrove.operators.blocks import block_features
from loggrove.operators.clean import clean, known, recognized
from loggrove.operators.prefix import prefix_features
from loggrove.operators.vocab import append_codes
from loggrove.schema import ENCODED_COLUMNS, FEATURE_COLUMNS, PREFIX_FIXED_COLUMNS
from loggrove.scratch import written
from loggrove.sources.lines import read_lines, stream_lines
from loggrove.sources.registry import parse
from loggrove.streaming import blocks as stream_blocks
from loggrove.streaming import jobs


def line(second, block, text="Receiving block {} src: /10.0.0.1:1 dest: /10.0.0.2:2", level="INFO"):
    return f"081109 {20 + second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d} 145 {level} dfs.A: {text.format(block)}"


class Run:
    """One replay: each list of lines is delivered as one file and one micro-batch."""

    def __init__(self, spark, folder, deliveries, ks=(2, 3), timeout=100):
        source, checkpoint, self.number = str(folder / "in"), str(folder / "state"), 0
        os.makedirs(source)
        for i, lines in enumerate(deliveries):
            path = os.path.join(source, f"{i}.log")
            with open(path, "w", encoding="utf-8") as handle:
                handle.write("\n".join(lines) + "\n")
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
        self.batch = written(clean(recognized(parse(read_lines(spark, source), "hdfs"))), "batch")
        self.vocab = written(append_codes(self.batch.select(*[known(F.col(c)).alias(c) for c in ENCODED_COLUMNS])), "vocab")
        events = stream_blocks.encoded_events(stream_lines(spark, source, 1), "hdfs", self.vocab)
        name = "run_" + folder.name.replace("-", "_")
        listener = jobs.InputCounts()
        spark.streams.addListener(listener)
        query = stream_blocks.block_stream(events, "hdfs", ks, timeout_seconds=timeout).writeStream.format("memory").queryName(name).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # the last batch's progress comes after the end
        spark.streams.removeListener(listener)
        self.input = listener.totals(query)
        self.out = spark.table(name)
        self.open = stream_blocks.open_blocks(spark, checkpoint)

    def count(self, column):
        return self.out.where("kind = 'counts'").agg(F.sum(column)).first()[0]

    def finals(self):
        return {r["block_id"]: r for r in self.out.where("kind = 'final'").collect()}


def test_parity_with_batch(spark, tmp_path):
    lines = [line(i, f"blk_{i % 3}", level="WARN" if i % 5 == 0 else "INFO") for i in range(12)]
    lines += [lines[0], "not a log line", line(20, "blk_1", "Received block {} of size 77 from /10.0.0.9")]
    run = Run(spark, tmp_path, [lines[:4], lines[4:9], lines[9:]], (2, 3, 5), None)
    columns = ["block_id", *FEATURE_COLUMNS]
    finished = {tuple(r) for r in run.open.select(columns).collect()}
    assert finished == {tuple(r) for r in block_features(run.batch, run.vocab).select(columns).collect()} and len(finished) == 3
    columns = ["block_id", "k", *PREFIX_FIXED_COLUMNS, "type_counts"]
    key = lambda r: tuple(tuple(sorted(v.items())) if isinstance(v, dict) else v for v in r)
    snapshots = {key(r) for r in run.out.where("kind = 'snapshot'").select(columns).collect()}
    expected = prefix_features(run.batch, (2, 3, 5), run.vocab).where("total_events >= k").select(columns).collect()
    assert snapshots == {key(r) for r in expected}
    assert (run.count("accepted"), run.count("duplicates"), run.count("late")) == (13, 1, 0)
    assert (run.input["lines_received"], run.input["lines_unparsed"], run.input["unseen_component"]) == (15, 1, 0)


def test_snapshot_is_taken_mid_batch(spark, tmp_path):
    run = Run(spark, tmp_path, [[line(i, "blk_1", level="WARN" if i >= 2 else "INFO") for i in range(6)]], (2,), None)
    (row,) = run.out.where("kind = 'snapshot'").collect()
    assert (row["n_events"], row["warn_count"], row["elapsed_seconds"]) == (2, 0, 1)


def test_silence_closes_a_block_and_late_lines_are_ignored(spark, tmp_path):
    deliveries = [
        [line(0, "blk_1"), line(5, "blk_2")],
        [line(100, "blk_3")],   # blk_1 is exactly 100 s silent: not more than the timeout
        [line(105, "blk_3")],   # blk_1 is over it, blk_2 exactly on it
        [line(106, "blk_3")],   # the watermark of the batch before closes blk_1
        [line(107, "blk_1")],   # late
        [line(108, "blk_3")],
    ]
    run = Run(spark, tmp_path, deliveries)
    finals = run.finals()
    assert finals["blk_1"]["event_frequency"] == 1 and finals["blk_1"]["reason"] == "timeout"
    assert "blk_3" not in finals
    assert run.count("late") == 1
    assert {r["block_id"] for r in run.open.collect()} == {"blk_1", "blk_2", "blk_3"} - set(finals)


def test_no_timeout_keeps_blocks_open(spark, tmp_path):
    run = Run(spark, tmp_path, [[line(0, "blk_1")], [line(3 * 3600, "blk_2")], [line(3 * 3600 + 1, "blk_1")]], timeout=None)
    assert run.finals() == {} and {r["block_id"]: r["event_frequency"] for r in run.open.collect()} == {"blk_1": 2, "blk_2": 1}
    assert run.open.first()["reason"] == "end_of_stream"


def test_a_line_out_of_order_moves_the_last_arrival(spark, tmp_path):
    run = Run(spark, tmp_path, [[line(50, "blk_1"), line(40, "blk_1")]], timeout=None)
    (row,) = run.open.collect()
    assert row["last_seconds"] - row["first_seconds"] == 10 and row["event_seconds"] == row["first_seconds"]


@pytest.mark.parametrize("text,code", [("Receiving block {} src: /10.0.0.1:1 dest: /10.0.0.2:2", 0), ("Served block {} to /10.0.0.2", 1)])
def test_unseen_values_get_the_next_code(spark, text, code):
    vocab = spark.createDataFrame([("event_type", "RECEIVE_BLOCK", 0), ("component", "dfs.A", 0)], "column string, value string, code int")
    frame = spark.createDataFrame([(0, line(0, "blk_1", text))], "arrival_seq long, value string")
    row = stream_blocks.encoded_events(frame, "hdfs", vocab).first()
    assert row["event_type_encoded"] == code and row["component_encoded"] == 0 and row["source_ip_encoded"] == 0


SNAPSHOT = {"kind": "snapshot", "n_events": 3, "elapsed_seconds": 1, "distinct_event_types": 1, "distinct_components": 1, "warn_count": 0,
            "error_count": 0, "block_size_max": 0.0, "first_component_encoded": 0, "first_event_type_encoded": 0,
            "dominant_component_encoded": 0, "dominant_event_type_encoded": 0, "event_seconds": 100}
FINAL = {"kind": "final", "hour_of_day": 1, "is_error": 0, "component_encoded": 0, "event_type_encoded": 0, "block_size": 1.0, "event_frequency": 4,
         "source_ip_encoded": 0, "destination_ip_encoded": 0, "first_seconds": 1, "last_seconds": 9, "event_seconds": 9, "reason": "timeout"}


@pytest.fixture(scope="module")
def models(spark):
    from loggrove.operators import forest as forests
    from loggrove.operators.forest import ForestParams
    from loggrove.operators.prefix import model_columns
    from loggrove.operators.retention import Normalizer, Policy

    rows = spark.range(200).select(F.col("id").cast("string").alias("block_id"), *[
        (F.xxhash64("id", F.lit(c)) % 50).cast("double").alias(c) for c in (*FEATURE_COLUMNS, *model_columns(["a"]))])
    early = {k: ForestParams(trees=5, features=tuple(PREFIX_FIXED_COLUMNS)) for k in ("3", "5")}
    both = rows.withColumn("k", F.explode(F.array(F.lit("3"), F.lit("5"))))
    deployed = forests.train(rows, ForestParams(trees=5, contamination=0.1))
    return jobs.Scorer(deployed, forests.train(both, early, "k"), {3: 0.0, 5: 0.0}, ["a"], deployed, Policy(0.6, 0.3, 0.1, 0.5, 0.25, 0.2),
                       Normalizer(0.0, 1.0, 0.0, 3.0, [0.0, 1.0]))


def batch(spark, *rows):
    return spark.createDataFrame([{**dict.fromkeys(stream_blocks.OUTPUT_SCHEMA.names), **r} for r in rows], stream_blocks.OUTPUT_SCHEMA)


def test_runs_keep_apart_and_a_block_is_warned_of_once(spark, tmp_path, models):
    out = str(tmp_path / "out")
    three, five = ({**SNAPSHOT, "block_id": "b", "k": k} for k in (3, 5))
    counts = {"kind": "counts", "block_id": "b", "accepted": 3, "duplicates": 1, "late": 0}
    jobs.write_outputs(batch(spark, three, counts), models, "one", out, 0)
    jobs.write_outputs(batch(spark, five, counts), models, "one", out, 1)
    jobs.write_outputs(batch(spark, five, counts), models, "one", out, 1)  # a repeated batch
    jobs.write_outputs(batch(spark, three, {**FINAL, "block_id": "b"}, {**counts, "accepted": 9}), models, "two", out, 0)
    tables = jobs.read_outputs(spark, out)
    early = tables["alerts"].where("type = 'early_warning'").select("run_id", "block_id", "k").collect()
    assert sorted(tuple(r) for r in early) == [("one", "b", 3), ("two", "b", 3)]
    assert tables["decisions"].select("run_id", "block_id").collect() == [("two", "b")]
    totals = {r["run_id"]: r["accepted"] for r in tables["counts"].groupBy("run_id").agg(F.sum("accepted").alias("accepted")).collect()}
    assert totals == {"one": 6, "two": 9}
    status = jobs.run_status(tables["alerts"], tables["decisions"], tables["counts"]).collect()
    assert [(r["run_id"], r["accepted"]) for r in status] == [("two", 9)]
    assert jobs.read_outputs(spark, out, "one")["decisions"].count() == 0


def test_input_counts_outlast_the_progress_list(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(110):
        (source / f"{i}.txt").write_text(f"line {i}\n")
    listener = jobs.InputCounts()
    spark.streams.addListener(listener)
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source)).observe("input", F.count(F.lit(1)).alias("lines_received"))
    query = lines.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    assert listener.totals(query) == {"lines_received": 110}
