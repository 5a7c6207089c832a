import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loggrove.operators import arrival, prefix
from loggrove.operators.ordering import exact_quantiles, grouped_quantile, ranked

LOG = "arrival_seq long, datetime timestamp_ntz, log_level string, component string, event_type string, block_id string, block_size double"
START = dt.datetime(2008, 11, 9, 20, 0, 0)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def random_log(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, at(i * 3 + rng.randint(-20, 20)), "INFO", "c", "e", "hot" if rng.random() < 0.4 else f"b{rng.randint(0, 40)}", 0.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, LOG).repartition(5)


@pytest.mark.parametrize("chunk", [7, 100, 10_000])
def test_gaps_and_positions_do_not_depend_on_chunks(spread, chunk):
    rows, log = random_log(spread)
    gaps, last, back, seen, expected_positions = defaultdict(int), {}, defaultdict(int), defaultdict(int), {}
    for i, t, *_, block, _size in rows:
        expected_positions[i] = (seen[block], None if block not in last else int((t - last[block]).total_seconds()))
        gaps[block] = max(gaps[block], expected_positions[i][1] or 0)
        back[block] += (expected_positions[i][1] or 0) < 0
        last[block], seen[block] = t, seen[block] + 1
    found = {r["block_id"]: (r["longest_gap"], r["time_inversions"], r["lines"]) for r in arrival.longest_gaps(log, chunk).collect()}
    assert found == {b: (gaps[b], back[b], seen[b]) for b in seen}
    placed = {r["arrival_seq"]: (r["position"], r["gap_seconds"]) for r in arrival.positions(log, chunk).collect()}
    assert placed == expected_positions
    inversions = sum(b[1] < a[1] for a, b in zip(rows, rows[1:]))
    assert arrival.time_inversions(log, (), chunk).first()["time_inversions"] == inversions


def test_smallest_timeout(spark):
    gaps = spark.createDataFrame([("a", 10800), ("b", 18000), ("c", 0)], "block_id string, longest_gap long")
    assert arrival.smallest_timeout_covering(gaps, 2 / 3) == 10800
    assert arrival.smallest_timeout_covering(gaps, 1.0) == 18000
    shares = {r["timeout"]: r["covered"] for r in arrival.timeout_coverage(gaps, (10800, 3600)).collect()}
    assert shares == {10800: 2, 3600: 1}


@pytest.fixture
def fixture_log(spark):
    rows = [("a", 0, "INFO", "c1", "ALLOCATE", 0), ("b", 1, "INFO", "c1", "RECEIVE", 5), ("a", 2, "WARN", "c2", "RECEIVE", 0),
            ("a", 4, "INFO", "c1", "RECEIVE", 0), ("b", 5, "ERROR", "c1", "RECEIVE", 7), ("c", 6, "INFO", "c2", "STORE", 1),
            ("a", 9, "FATAL", "c1", "STORE", 9), ("b", 3, "INFO", "c2", "ALLOCATE", 1), ("a", 7, "INFO", "c2", "STORE", 2)]
    data = [(i, at(s), level, component, event, block, float(size)) for i, (block, s, level, component, event, size) in enumerate(rows)]
    return spark.createDataFrame(data, LOG).repartition(3)


def test_prefix_features(spark, fixture_log):
    vocab = spark.createDataFrame([("component", "c1", 0), ("component", "c2", 1), ("event_type", "STORE", 0), ("event_type", "RECEIVE", 1),
                                   ("event_type", "ALLOCATE", 2)], "column string, value string, code int")
    out = prefix.count_columns(prefix.prefix_features(fixture_log, (3, 5), vocab), ["ALLOCATE", "RECEIVE", "NEVER"])
    rows = {(r["block_id"], r["k"]): r.asDict() for r in out.collect()}
    a = rows[("a", 3)]
    assert (a["n_events"], a["elapsed_seconds"], a["count_ALLOCATE"], a["count_RECEIVE"], a["count_NEVER"]) == (3, 4, 1, 2, 0)
    assert (a["distinct_event_types"], a["distinct_components"], a["warn_count"], a["error_count"], a["block_size_max"]) == (2, 2, 1, 0, 0.0)
    assert (a["first_component_encoded"], a["first_event_type_encoded"], a["dominant_event_type_encoded"]) == (0, 2, 1)
    assert rows[("a", 5)]["error_count"] == 1 and rows[("a", 5)]["dominant_event_type_encoded"] == 0  # tie goes to the smaller code
    assert rows[("a", 3)]["total_events"] == 5 and rows[("a", 3)]["block_end_seconds"] - rows[("a", 3)]["prefix_end_seconds"] == 5
    assert rows[("c", 5)]["n_events"] == 1 and rows[("c", 5)]["elapsed_seconds"] == 0
    assert rows[("b", 3)]["elapsed_seconds"] == 4  # arrival order, not time order


def test_prefix_lengths_are_checked(fixture_log):
    for ks in ((), (0,)):
        with pytest.raises(ValueError):
            prefix.prefix_features(fixture_log, ks)
    assert prefix.check_lengths((1000, 3, 3)) == [3, 1000]


def test_prefix_of_a_hot_block_is_limited_before_the_shuffle(spread):
    _, log = random_log(spread)
    plan = prefix.first_events(log, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_ranked_matches_a_plain_sort(spread):
    rng = random.Random(3)
    data = [(rng.choice("xyz"), rng.choice([1.0, 1.0, 1.0, 2.0, 3.0]), i) for i in range(900)]
    frame = spread.createDataFrame(data, "g string, v double, id long").repartition(6)
    out = ranked(frame, [F.col("v").desc(), "id"], within=("g",), totals={"upto": F.col("id")}).collect()
    expected, running = {}, defaultdict(int)
    for g in "xyz":
        for place, (_, v, i) in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            running[g] += i
            expected[i] = (place, running[g])
    assert {r["id"]: (r["position"], r["upto"]) for r in out} == expected
    plain = ranked(frame, ["v", "id"]).collect()
    assert [r["position"] for r in sorted(plain, key=lambda r: (r["v"], r["id"]))] == list(range(1, 901))


def test_quantiles_match_numpy(spread):
    import numpy as np

    rng = np.random.default_rng(0)
    values = np.r_[rng.normal(size=400), np.zeros(300), rng.integers(0, 5, 300)].astype(float)
    frame = spread.createDataFrame([(float(v), "g" if i % 2 else "h") for i, v in enumerate(values)], "v double, g string").repartition(5)
    grid = [i / 1000 for i in range(1001)]
    assert np.allclose(exact_quantiles(frame, "v", grid), np.quantile(values, grid), atol=0, rtol=1e-12)
    assert exact_quantiles(frame.where("v > 1e9"), "v", [0.5]) is None
    medians = {r["g"]: r["m"] for r in grouped_quantile(frame, "v", 0.5, ("g",), "m").collect()}
    assert medians["g"] == pytest.approx(np.median(values[1::2])) and medians["h"] == pytest.approx(np.median(values[0::2]))
