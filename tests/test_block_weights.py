"""Blocks are counted where their lines lie; only those beyond the limit are spread over tasks."""

import datetime

from loggrove.operators import blocks
from loggrove.schema import ENCODED_COLUMNS


def log(spark):
    rows = []
    for i in range(120):
        block = None if i % 17 == 0 else "large" if i % 2 else f"b{i % 9}"
        rows.append((block, None if i % 23 == 0 else datetime.datetime(2024, 1, 1, i % 24, i % 60), "error" if i % 11 == 0 else "INFO", i % 7 or None,
                     f" c{i % 3} ", ["x", "y", "<NA>", ""][i % 4], None if i % 5 else f"ip{i % 6}", None))
    return spark.createDataFrame(rows, "block_id string, datetime timestamp_ntz, log_level string, block_size long, " + ", ".join(
        f"{c} string" for c in ENCODED_COLUMNS))


def rows(frame):
    return sorted(map(repr, (tuple(r) for r in frame.collect())))


def test_light_and_heavy_blocks_agree(spark):
    lines = log(spark)
    for made in (blocks.block_features, blocks.block_metadata, blocks.value_counts):
        plain, mixed, spread = (made(lines, light=n) for n in (1000, 20, 0))
        assert rows(plain) == rows(mixed) == rows(spread)


def test_a_line_moves_once(spark):
    plan = blocks.block_features(log(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_the_first_of_equally_frequent_codes(spark):
    lines = spark.createDataFrame([("b", c) for c in ("z", "a", "z", "a", "m")], "block_id string, component string").selectExpr(
        "timestamp_ntz'2024-01-01' as datetime", "'INFO' as log_level", "block_id", "1L as block_size", "component", "'e' as event_type",
        "'s' as source_ip", "'d' as destination_ip")
    known = spark.createDataFrame([("component", "a", 3), ("component", "z", 2)], "column string, value string, code int")
    row = blocks.block_features(lines, known).first()
    assert row["component_encoded"] == 2 and row["event_type_encoded"] == -1
    assert blocks.block_features(lines).first()["component_encoded"] == 0
