"""Coercion, invalid rows, duplicates, accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from loggrove.operators import clean
from loggrove.queries import rendered
from loggrove.queries.registry import query
from loggrove.queries.sqltext import EVENTS_K
from loggrove.sources.registry import parse
from loggrove.sources.tables import structured_events, twice

RAW = f"""(SELECT event_id AS arrival_seq, CASE WHEN k = 0 THEN NULL ELSE ' ' || strftime(ts, '%Y-%m-%d') END AS date,
  CASE WHEN k = 1 THEN '25:61:00' ELSE strftime(ts, '%H:%M:%S') END AS time,
  CASE WHEN k = 2 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS pid,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS log_level,
  CASE WHEN k = 3 THEN '  ' WHEN k = 4 THEN '<NA>' ELSE ' svc-' || (k % 5) || ' ' END AS component, event_type,
  CASE WHEN k = 5 THEN NULL ELSE 'user-' || user_id END AS block_id,
  CASE WHEN k = 6 THEN '' WHEN k = 7 THEN '<NA>' ELSE '10.0.' || (user_id % 7) || '.' || (k % 20) END AS source_ip,
  CASE WHEN event_type = 'purchase' THEN '10.1.0.' || (k % 10) END AS destination_ip,
  CASE WHEN event_type = 'purchase' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) WHEN event_type = 'view' THEN 'x' END AS block_size,
  event_type || ' k=' || k AS raw_message FROM {EVENTS_K})"""

COERCED = f"""(SELECT arrival_seq, TRY_CAST(trim(date) || ' ' || trim(time) AS TIMESTAMP) AS datetime, trim(date) AS date, trim(time) AS time,
  TRY_CAST(pid AS BIGINT) AS pid, log_level, CASE WHEN trim(component) IN ('', '<NA>') THEN NULL ELSE trim(component) END AS component,
  event_type, block_id, CASE WHEN source_ip IS NULL OR trim(source_ip) IN ('', '<NA>') THEN 'UNKNOWN' ELSE source_ip END AS source_ip,
  coalesce(destination_ip, 'UNKNOWN') AS destination_ip, coalesce(TRY_CAST(block_size AS DOUBLE), 0.0) AS block_size, raw_message FROM {RAW})"""

VALID = f"(SELECT * FROM {COERCED} WHERE datetime IS NOT NULL AND pid IS NOT NULL AND component IS NOT NULL AND block_id IS NOT NULL)"


@query(f"SELECT * FROM {COERCED}")
def coerced_columns(spark, folder):
    return clean.coerce(structured_events(spark, folder))


@query(f"SELECT * FROM {VALID}")
def rows_with_valid_required_fields(spark, folder):
    return clean.drop_invalid(clean.coerce(structured_events(spark, folder)))


@query(f"SELECT min(arrival_seq) AS arrival_seq, * EXCLUDE (arrival_seq) FROM {VALID} GROUP BY ALL")
def exact_duplicates_removed(spark, folder):
    """Every row delivered twice; the first arrival stays."""
    return clean.clean(twice(structured_events(spark, folder)))


@query(f"""SELECT block_id, count(*) AS lines FROM (SELECT * FROM {VALID} UNION ALL SELECT * FROM {VALID}) GROUP BY ALL""")
def repeats_kept_when_they_are_real(spark, folder):
    """A source whose identical lines are real bursts keeps them all."""
    return clean.clean(twice(structured_events(spark, folder)), dedupe=False).groupBy("block_id").agg(F.count("*").alias("lines"))


@query(f"SELECT arrival_seq, block_id, event_type FROM ({rendered.OPENSTACK_SQL.replace('{request}', 'FALSE')}) WHERE date IS NOT NULL AND block_id IS NOT NULL")
def recognized_lines(spark, folder):
    parsed = parse(rendered.openstack_lines(spark, folder), "openstack")
    return clean.recognized(parsed).select("arrival_seq", "block_id", "event_type")


@query(f"""SELECT count(*) AS lines_or_records, count(*) FILTER (date IS NULL) AS unparsed,
  count(*) FILTER (date IS NOT NULL AND block_id IS NULL) AS no_block_id, count(*) FILTER (date IS NOT NULL AND block_id IS NOT NULL) AS recognized,
  count(*) FILTER (date IS NOT NULL AND block_id IS NOT NULL) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (arrival_seq) FROM {VALID})) AS dropped_by_cleaner,
  (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (arrival_seq) FROM {VALID})) AS events_after_cleaning,
  (SELECT count(DISTINCT block_id) FROM {VALID}) AS blocks FROM (SELECT * FROM {RAW} UNION ALL SELECT * FROM {RAW})""")
def ingest_accounting(spark, folder):
    return clean.ingest_stats(twice(structured_events(spark, folder)))
