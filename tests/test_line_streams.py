import os

import pytest
from pyspark.sql import functions as F

from loggrove.schema import ARRIVAL_CHUNK, ARRIVAL_SEQ
from loggrove.sources.lines import read_lines, stream_lines, tail_lines
from loggrove.sources.tail import TailReader


def collected(spark, lines, folder, name):
    query = lines.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def in_order(frame):
    return [r["value"] for r in frame.orderBy(ARRIVAL_CHUNK, ARRIVAL_SEQ).collect()]


def test_a_large_file_streams_in_many_tasks_and_every_line_comes_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"line {i} " + "x" * (i * 37 % 211) for i in range(20_000)]
    (tmp_path / "in" / "a.log").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        streamed = stream_lines(spark, str(tmp_path / "in")).withColumn("task", F.spark_partition_id())
        found = collected(spark, streamed, tmp_path, "many_tasks")
        assert found.select("task").distinct().count() > 10
        assert in_order(found) == lines == in_order(read_lines(spark, str(tmp_path / "in")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("split", [3, 17, 1 << 20])
def test_growing_files(spark, tmp_path, split):
    """What is appended comes with the next batch; a line without its end waits; lines cut by ranges come once."""
    source = tmp_path / "in"
    source.mkdir()
    a, b = source / "a.log", source / "b.log"
    a.write_bytes(b"one\r\n\ntwo \xff\nthr")
    b.write_bytes("é first\n".encode())
    (source / "_hidden").write_text("no\n")
    def ended(path):
        rows = spark.read.parquet(str(tmp_path / "out")).where(F.col(ARRIVAL_CHUNK).endswith(path)).orderBy(ARRIVAL_SEQ).collect()
        return [r["value"] for r in rows]

    def step():
        tail_lines(spark, str(source), split).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "tail-state")).trigger(processingTime="0 seconds").start()
        query = spark.streams.active[-1]
        query.processAllAvailable()
        query.stop()

    step()
    assert ended("a.log") == ["one", "", "two \ufffd"] and ended("b.log") == ["é first"]
    with open(a, "ab") as file:
        file.write(b"ee\nfour and more words\n")
    step()
    step()
    assert ended("a.log") == ["one", "", "two \ufffd", "three", "four and more words"] and ended("b.log") == ["é first"]


def test_ranges_of_growing_files(tmp_path):
    """Every line is read by exactly one range, whatever their size; a shrunken file is read anew."""
    text = "".join(f"{'y' * (i % 13)}{i}\n" for i in range(200)).encode()
    (tmp_path / "a").write_bytes(text + b"no end")
    for split in (1, 5, 64, 10_000):
        reader = TailReader({"path": str(tmp_path), "splitBytes": str(split)})
        end = reader.latestOffset()
        assert list(end.values()) == [len(text)]
        found = [(n, v) for p in reader.partitions({}, end) for batch in reader.read(p) for n, v in zip(batch[1].to_pylist(), batch[2].to_pylist())]
        assert [v for _, v in found] == text.decode().split("\n")[:-1] and all(text[n:].startswith(v.encode()) for n, v in found)
    (tmp_path / "a").write_bytes(b"new\n")
    again = reader.latestOffset()
    assert [v for p in reader.partitions(end, again) for batch in reader.read(p) for v in batch[2].to_pylist()] == ["new"]
    os.remove(tmp_path / "a")
    assert reader.partitions(again, reader.latestOffset()) == []
    assert TailReader({"path": str(tmp_path / "none")}).latestOffset() == {}


def test_deliveries_are_spread_as_they_grow(spread, tmp_path, monkeypatch):
    """Rows of one row group are worded by several tasks, and a delivery of many lines is written by more tasks; nothing else changes."""
    from loggrove.queries import rendered, streams

    spark = spread

    spark.range(4_000, numPartitions=1).selectExpr(
        "id AS event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 7) AS ts", "id % 13 AS user_id",
        "element_at(array('click', 'error', 'signup'), CAST(id % 3 AS INT) + 1) AS event_type", "id / 3 AS value",
        "concat('{\"k\": ', id % 100, '}') AS props").write.parquet(str(tmp_path / "events.parquet"))
    folder = str(tmp_path)
    lines = rendered.hdfs_lines(spark, folder, dealt=True)
    with_task = lines.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in with_task}) > 1 and sorted((r[0], r[1]) for r in with_task) == sorted(tuple(r) for r in rendered.hdfs_lines(spark, folder).collect())
    assert streams.files_of(lines) == streams.FILES
    before = sorted(map(tuple, streams.stream_duplicates_by_block(spark, folder).collect()))
    monkeypatch.setattr(streams, "FILE_LINES", 200)
    files = streams.files_of(lines)
    assert files == 7
    parts = list(streams.deliveries(lines, files))
    assert [p.rdd.getNumPartitions() for p in parts] == [7] * streams.DELIVERIES
    assert sorted(map(tuple, streams.stream_duplicates_by_block(spark, folder).collect())) == before
    assert sum(r[1] for r in before) + sum(r[2] for r in before) == 4_000 - 40 + 400
