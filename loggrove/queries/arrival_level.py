"""Positions, gaps, inversions and prefix features."""

from __future__ import annotations

from pyspark.sql import functions as F

from loggrove.operators import arrival, prefix
from loggrove.queries.registry import query
from loggrove.queries.sqltext import events_log as events_sql
from loggrove.queries.vocabulary import vocab_sql
from loggrove.schema import ARRIVAL_SEQ, PREFIX_LENGTHS
from loggrove.sources.tables import events_log, read_table

# Small chunks, so the checks cross many chunk edges inside each block.
CHUNK = 512

# The orders table numbered by key is not in time order: it exercises inversions.
ORDERS_SQL = """(SELECT o_orderkey AS arrival_seq, o_orderdate AS datetime, 'c-' || (o_custkey % 50) AS block_id FROM orders)"""
GAPS = """(SELECT block_id, greatest(coalesce(max(step), 0), 0) AS longest_gap, count(*) FILTER (step < 0) AS time_inversions, count(*) AS lines
  FROM (SELECT block_id, CAST(epoch(datetime) AS BIGINT) - lag(CAST(epoch(datetime) AS BIGINT)) OVER (PARTITION BY block_id ORDER BY arrival_seq) AS step
        FROM {log}) GROUP BY block_id)"""


def order_arrivals(spark, folder):
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("long").alias(ARRIVAL_SEQ), F.col("o_orderdate").cast("timestamp_ntz").alias("datetime"),
        F.concat(F.lit("c-"), F.col("o_custkey") % 50).alias("block_id"))


@query(f"""SELECT arrival_seq, block_id, row_number() OVER w - 1 AS position,
  CAST(epoch(datetime) AS BIGINT) - lag(CAST(epoch(datetime) AS BIGINT)) OVER w AS gap_seconds
FROM {events_sql()} WINDOW w AS (PARTITION BY block_id ORDER BY arrival_seq)""")
def positions_in_block(spark, folder):
    return arrival.positions(events_log(spark, folder), CHUNK).select("arrival_seq", "block_id", "position", "gap_seconds")


@query(f"SELECT * FROM {GAPS.replace('{log}', events_sql())}")
def longest_gaps(spark, folder):
    return arrival.longest_gaps(events_log(spark, folder), CHUNK)


@query(f"SELECT * FROM {GAPS.replace('{log}', ORDERS_SQL)}")
def longest_gaps_out_of_order(spark, folder):
    return arrival.longest_gaps(order_arrivals(spark, folder), CHUNK)


@query(f"""SELECT count(*) AS lines, count(*) FILTER (datetime < before) AS time_inversions FROM (
  SELECT datetime, lag(datetime) OVER (ORDER BY arrival_seq) AS before FROM {ORDERS_SQL})""")
def time_inversions(spark, folder):
    return arrival.time_inversions(order_arrivals(spark, folder), (), CHUNK)


EVENT_GAPS = GAPS.replace("{log}", events_sql())
P = ", ".join(f"CAST({p} AS DOUBLE)" for p in arrival.GAP_PERCENTILES)


@query(f"""SELECT unnest([{P}]) AS percentile, unnest(quantile_cont(CAST(longest_gap AS DOUBLE), [{', '.join(str(p) for p in arrival.GAP_PERCENTILES)}])) AS gap_seconds
FROM {EVENT_GAPS}""")
def gap_percentiles(spark, folder):
    return arrival.gap_percentiles(arrival.longest_gaps(events_log(spark, folder), CHUNK))


@query(" UNION ALL ".join(f"""SELECT CAST({t} AS BIGINT) AS timeout, count(*) FILTER (longest_gap <= {t}) AS covered, count(*) AS blocks,
  count(*) FILTER (longest_gap <= {t}) / count(*) AS coverage FROM {EVENT_GAPS}""" for t in arrival.CANDIDATE_TIMEOUTS))
def timeout_coverage(spark, folder):
    return arrival.timeout_coverage(arrival.longest_gaps(events_log(spark, folder), CHUNK))


@query(f"""SELECT CAST(0.99 AS DOUBLE) AS share, min(longest_gap) AS timeout FROM (SELECT longest_gap, row_number() OVER (ORDER BY longest_gap) AS r,
  count(*) OVER () AS n FROM {EVENT_GAPS}) WHERE r = ceil(0.99 * n)""")
def smallest_covering_timeout(spark, folder):
    gaps = arrival.longest_gaps(events_log(spark, folder), CHUNK)
    value = arrival.smallest_timeout_covering(gaps, 0.99)
    # Report the block(s) count that fixes it from the data itself, not a constant row.
    return gaps.where(F.col("longest_gap") == value).agg(F.lit(0.99).alias("share"), F.min("longest_gap").alias("timeout"))


def prefix_sql(log: str, ks, counts: bool = True) -> str:
    """One SELECT per k over the coded log."""
    def one(k: int) -> str:
        return f"""SELECT block_id, {k} AS k, count(*) AS n_events, max(s) - min(s) AS elapsed_seconds,
          count(DISTINCT et) AS distinct_event_types, count(DISTINCT co) AS distinct_components,
          count(*) FILTER (lv IN ('WARN', 'WARNING')) AS warn_count, count(*) FILTER (lv IN ('ERROR', 'FATAL', 'CRITICAL')) AS error_count,
          max(sz) AS block_size_max, arg_min(co, rn) AS first_component_encoded, arg_min(et, rn) AS first_event_type_encoded,
          max(s) AS prefix_end_seconds{types} FROM coded WHERE rn <= {k} GROUP BY block_id"""
    names = ("view", "click", "purchase", "signup", "error") if counts else ()
    types = "".join(f", CAST(count(*) FILTER (event_type = '{n}') AS INTEGER) AS count_{n}" for n in names)
    modes = lambda c, name: " UNION ALL ".join(f"""SELECT block_id, k, {c} AS {name} FROM (SELECT block_id, {k} AS k, {c},
          row_number() OVER (PARTITION BY block_id ORDER BY count(*) DESC, {c}) AS r FROM coded WHERE rn <= {k} GROUP BY block_id, {c}) WHERE r = 1""" for k in ks)  # noqa: E731
    return f"""WITH vocab AS {vocab_sql(log)}, coded AS (SELECT l.*, CAST(epoch(datetime) AS BIGINT) AS s, log_level AS lv, vc.code AS co, vt.code AS et,
        coalesce(CAST(block_size AS DOUBLE), 0.0) AS sz, row_number() OVER (PARTITION BY block_id ORDER BY arrival_seq) AS rn FROM {log} l
        JOIN vocab vc ON vc."column" = 'component' AND vc.value = l.component JOIN vocab vt ON vt."column" = 'event_type' AND vt.value = l.event_type),
      per_k AS ({' UNION ALL '.join(one(k) for k in ks)}),
      totals AS (SELECT block_id, count(*) AS total_events, max(s) AS block_end_seconds FROM coded GROUP BY block_id)
    SELECT * FROM per_k JOIN totals USING (block_id) JOIN ({modes('co', 'dominant_component_encoded')}) USING (block_id, k)
      JOIN ({modes('et', 'dominant_event_type_encoded')}) USING (block_id, k)"""


EVENT_TYPES = ("view", "click", "purchase", "signup", "error")


def prefixes(spark, folder, block):
    found = prefix.prefix_features(events_log(spark, folder, block), PREFIX_LENGTHS)
    return prefix.count_columns(found, EVENT_TYPES).drop("type_counts")


@query(prefix_sql(events_sql(), PREFIX_LENGTHS))
def prefix_features_by_user(spark, folder):
    return prefixes(spark, folder, "user")


@query(prefix_sql(events_sql("identity_hour"), PREFIX_LENGTHS))
def prefix_features_of_short_blocks(spark, folder):
    return prefixes(spark, folder, "identity_hour")


@query(f"""SELECT arrival_seq, block_id, rn AS position FROM (SELECT arrival_seq, block_id, CAST(row_number() OVER (PARTITION BY block_id ORDER BY arrival_seq) AS INTEGER) AS rn
FROM {events_sql()}) WHERE rn <= 20""")
def first_events_of_blocks(spark, folder):
    return prefix.first_events(events_log(spark, folder), 20).select("arrival_seq", "block_id", "position")


@query(f"""SELECT block_id, arg_min(component, arrival_seq) AS first_component, arg_min(event_type, arrival_seq) AS first_event_type FROM {events_sql()} GROUP BY block_id""")
def first_categories(spark, folder):
    return events_log(spark, folder).groupBy("block_id").agg(
        F.min_by("component", "arrival_seq").alias("first_component"), F.min_by("event_type", "arrival_seq").alias("first_event_type"))


@query(f"""SELECT block_id, count(*) FILTER (arrival_seq < 2000) AS lines_in_replay, count(*) AS lines_in_file,
  count(*) FILTER (arrival_seq < 2000) >= count(*) AS complete FROM {events_sql("identity_hour")} GROUP BY block_id""")
def lines_inside_replay(spark, folder):
    """Complete or cut off, for a replay that stopped after 2,000 lines."""
    from loggrove.streaming.replay import replay_coverage

    return replay_coverage(events_log(spark, folder, "identity_hour"), 2000)


