import datetime as dt

import pytest
from pyspark.sql import functions as F

from loggrove.operators import blocks, clean, vocab
from loggrove.operators.vocab import append_codes
from loggrove.schema import STRUCTURED_COLUMNS

RAW = "arrival_seq long, date string, time string, pid string, log_level string, component string, event_type string, block_id string, " \
      "source_ip string, destination_ip string, block_size string, raw_message string"
ROW = ("2008-11-09", "20:35:19", "145", "INFO", "dfs.A", "RECEIVE_BLOCK", "blk_1", "10.0.0.1", "10.0.0.2", "12", "msg")


def changed(**values):
    names = [c.split()[0] for c in RAW.split(", ")][1:]
    return tuple(values.get(n, v) for n, v in zip(names, ROW))


def raw(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RAW)


def test_missing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="block_size"):
        clean.clean(raw(spark, ROW).drop("block_size"))
    with pytest.raises(ValueError, match="datetime"):
        blocks.block_features(raw(spark, ROW))


def test_cleaning(spark):
    rows = raw(spark, ROW, ROW, changed(source_ip=" ", destination_ip="<NA>", block_size=None, component=" dfs.B "),
               changed(time="25:00:00"), changed(pid="x"), changed(component="<NA>"), changed(event_type=""), changed(block_id=None))
    out = clean.clean(rows).orderBy("arrival_seq").collect()
    assert [r["arrival_seq"] for r in out] == [0, 2]
    assert out[0]["datetime"] == dt.datetime(2008, 11, 9, 20, 35, 19) and out[0]["pid"] == 145 and out[0]["block_size"] == 12.0
    assert (out[1]["source_ip"], out[1]["destination_ip"], out[1]["block_size"], out[1]["component"]) == ("UNKNOWN", "UNKNOWN", 0.0, "dfs.B")
    assert clean.clean(rows, dedupe=False).count() == 3


def test_first_arrival_over_two_order_columns(spark):
    rows = raw(spark, ROW, ROW).withColumn("arrival_chunk", F.when(F.col("arrival_seq") == 0, "b").otherwise("a"))
    (row,) = clean.clean(rows).collect()
    assert (row["arrival_chunk"], row["arrival_seq"]) == ("a", 1)


def test_ingest_stats(spark):
    rows = raw(spark, ROW, ROW, changed(date=None), changed(block_id=None), changed(pid="x"), changed(block_id="blk_2"))
    stats = clean.ingest_stats(rows).first().asDict()
    assert stats == {"lines_or_records": 6, "unparsed": 1, "no_block_id": 1, "recognized": 4, "dropped_by_cleaner": 2,
                     "events_after_cleaning": 2, "blocks": 2}


LOG = "arrival_seq long, datetime timestamp_ntz, log_level string, component string, event_type string, block_id string, " \
      "source_ip string, destination_ip string, block_size double"


def moment(hour, minute=0):
    return dt.datetime(2008, 11, 9, hour, minute)


@pytest.fixture
def log(spark):
    return spark.createDataFrame([
        (0, moment(21), "INFO", "b", "y", "blk_1", "10.0.0.1", "UNKNOWN", 5.0),
        (1, moment(20), "error", "a", "x", "blk_1", "10.0.0.2", "UNKNOWN", 9.0),
        (2, moment(3), "FATAL", "a", "x", "blk_2", "10.0.0.2", "UNKNOWN", 0.0),
        (3, moment(22), "INFO", "a", "y", "blk_1", "10.0.0.2", "UNKNOWN", 1.0),
    ], LOG)


def test_block_features(spark, log):
    out = {r["block_id"]: r.asDict() for r in blocks.block_features(log).collect()}
    one = out["blk_1"]
    assert (one["hour_of_day"], one["is_error"], one["block_size"], one["event_frequency"]) == (20, 1, 9.0, 3)
    assert (one["component_encoded"], one["event_type_encoded"], one["source_ip_encoded"]) == (0, 1, 1)
    assert out["blk_2"]["is_error"] == 0 and out["blk_2"]["hour_of_day"] == 3


def test_dominant_ties_follow_codes_for_features_and_text_for_metadata(spark):
    rows = [(i, moment(1), "INFO", c, "e", "blk_1", "ip", "ip", 0.0) for i, c in enumerate(["a", "b"])]
    log = spark.createDataFrame(rows, LOG)
    codes = spark.createDataFrame([("component", "b", 0), ("component", "a", 1), ("event_type", "e", 0), ("source_ip", "ip", 0),
                                   ("destination_ip", "ip", 0)], "column string, value string, code int")
    assert blocks.block_features(log, codes).first()["component_encoded"] == 0
    assert blocks.block_metadata(log).first()["component"] == "a"


def test_metadata_and_statistics(spark, log):
    out = {r["block_id"]: r for r in blocks.block_metadata(log).collect()}
    assert out["blk_1"]["first_seen"] == moment(20) and out["blk_1"]["component"] == "a" and out["blk_1"]["source_ip"] == "10.0.0.2"
    stats = {(r["kind"], r["name"]): r["n"] for r in blocks.dataset_stats(log).collect()}
    assert stats[("total_events", "all")] == 4 and stats[("total_blocks", "all")] == 2
    assert stats[("component", "a")] == 3 and stats[("log_level", "INFO")] == 2 and stats[("day", "2008-11-09")] == 4


def test_one_hot_block_matches_plain_counting(spread):
    rows = spread.range(20_000).select(
        F.col("id").alias("arrival_seq"), F.lit(moment(5)).cast("timestamp_ntz").alias("datetime"), F.lit("INFO").alias("log_level"),
        F.concat(F.lit("c"), F.col("id") % 7).alias("component"), F.concat(F.lit("e"), F.col("id") % 5).alias("event_type"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("b"), F.col("id"))).alias("block_id"),
        F.concat(F.lit("ip"), F.col("id") % 1000).alias("source_ip"), F.lit("UNKNOWN").alias("destination_ip"), F.lit(1.0).alias("block_size"))
    hot = blocks.block_metadata(rows).where("block_id = 'hot'").first()
    assert hot["event_frequency"] == 13_333 and hot["event_type"] == "e1"


def test_vocabulary_appends_and_never_moves(spark):
    first = append_codes(spark.createDataFrame([("b",), ("a",)], "component string"), columns=("component",))
    grown = append_codes(spark.createDataFrame([("0",), ("b",), (None,)], "component string"), first, ("component",))
    codes = {r["value"]: r["code"] for r in grown.collect()}
    assert codes == {"a": 0, "b": 1, "0": 2, "UNKNOWN": 3}
    assert vocab.conflicts(first, grown).count() == 0
    vocab.require_compatible(first, grown)
    moved = first.withColumn("code", F.lit(7))
    with pytest.raises(ValueError, match="renumbered"):
        vocab.require_compatible(first, moved)
    with pytest.raises(ValueError, match="no vocabulary"):
        vocab.require_compatible(None, grown)


def test_fingerprint_ignores_row_order_and_sees_changes(spark):
    rows = [("c", "a", 0), ("c", "b", 1), ("d", "a", 0)]
    schema = "column string, value string, code int"
    same = {vocab.fingerprint(spark.createDataFrame(r, schema)).first()[0] for r in (rows, rows[::-1])}
    other = vocab.fingerprint(spark.createDataFrame([("c", "a", 1), ("c", "b", 0), ("d", "a", 0)], schema)).first()[0]
    assert len(same) == 1 and other not in same and len(other) == 16


def test_salted_lookup_equals_broadcast_lookup(spread):
    left = spread.range(500).select("id", (F.col("id") % 3).alias("value"))
    right = spread.createDataFrame([(0, "x"), (1, "y")], "value long, code string")
    wide = vocab.lookup(left, right, ["value"], limit=1).orderBy("id").collect()
    assert [tuple(r) for r in wide] == [tuple(r) for r in vocab.lookup(left, right, ["value"]).select("value", "id", "code").orderBy("id").collect()]


def test_constant_columns(spark):
    frame = spark.createDataFrame([(1, 1, None, "g"), (1, 2, None, "g"), (1, 2, 3, "h")], "a int, b int, c int, g string")
    assert blocks.constant_columns(frame, ["a", "b", "c"]) == ["a"]
    assert blocks.constant_columns(frame, ["a", "b", "c"], by="g") == {"g": ["a", "c"], "h": ["a", "b", "c"]}
