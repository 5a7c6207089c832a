"""Block features, metadata and dataset statistics."""

from __future__ import annotations


from loggrove.operators import blocks
from loggrove.queries.registry import query
from loggrove.queries.sqltext import ORDER_LOG, dominant, events_log as events_sql, known
from loggrove.queries.vocabulary import vocab_sql
from loggrove.schema import ENCODED_COLUMNS
from loggrove.sources.tables import events_log, order_log


def coded_sql(log: str) -> str:
    joins = "".join(
        f" JOIN (SELECT value, code FROM vocab WHERE \"column\" = '{c}') v_{c} ON v_{c}.value = {known('l.' + c)}" for c in ENCODED_COLUMNS)
    codes = ", ".join(f"v_{c}.code AS {c}_encoded" for c in ENCODED_COLUMNS)
    return f"(SELECT l.block_id, l.datetime, l.log_level, l.block_size, {codes} FROM {log} l{joins})"


def features_sql(log: str, vocab: str | None = None) -> str:
    parts = "".join(f" JOIN {dominant('coded', f'{c}_encoded', f'{c}_encoded', f'{c}_encoded')} d_{c} USING (block_id)" for c in ENCODED_COLUMNS)
    return f"""WITH vocab AS {vocab or vocab_sql(log)}, coded AS {coded_sql(log)}, base AS (SELECT block_id,
      CAST(hour(min(datetime)) AS INTEGER) AS hour_of_day, CAST(max(CASE WHEN upper(log_level) = 'ERROR' THEN 1 ELSE 0 END) AS INTEGER) AS is_error,
      max(coalesce(CAST(block_size AS DOUBLE), 0.0)) AS block_size, count(*) AS event_frequency FROM coded GROUP BY block_id)
    SELECT * FROM base{parts}"""


def metadata_sql(log: str) -> str:
    named = f"(SELECT block_id, datetime, block_size, {', '.join(f'{known(c)} AS {c}' for c in ENCODED_COLUMNS)} FROM {log})"
    parts = "".join(f" JOIN {dominant('named', c, c, c)} d_{c} USING (block_id)" for c in ENCODED_COLUMNS)
    return f"""WITH named AS {named}, base AS (SELECT block_id, min(datetime) AS first_seen,
      max(coalesce(CAST(block_size AS DOUBLE), 0.0)) AS block_size, count(*) AS event_frequency FROM named GROUP BY block_id)
    SELECT * FROM base{parts}"""


@query(features_sql(events_sql()))
def block_features_by_user(spark, folder):
    return blocks.block_features(events_log(spark, folder))


@query(features_sql(events_sql("identity_hour")))
def block_features_by_identity_hour(spark, folder):
    return blocks.block_features(events_log(spark, folder, "identity_hour"))


@query(features_sql(ORDER_LOG))
def block_features_by_order(spark, folder):
    return blocks.block_features(order_log(spark, folder))


@query(metadata_sql(events_sql()))
def block_metadata_by_user(spark, folder):
    return blocks.block_metadata(events_log(spark, folder))


@query(metadata_sql(ORDER_LOG))
def block_metadata_by_order(spark, folder):
    return blocks.block_metadata(order_log(spark, folder))


@query(f"""SELECT block_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY n DESC, event_type) AS rn
  FROM (SELECT block_id, event_type, count(*) AS n FROM {ORDER_LOG} GROUP BY block_id, event_type)) WHERE rn = 1""")
def dominant_event_type(spark, folder):
    return blocks.dominant_values(order_log(spark, folder), "event_type")


def stats_sql(log: str) -> str:
    return f"""SELECT 'log_level' AS kind, log_level AS name, count(*) AS n FROM {log} GROUP BY ALL
UNION ALL SELECT 'event_type', event_type, count(*) FROM {log} GROUP BY ALL
UNION ALL SELECT 'component', component, count(*) FROM {log} GROUP BY ALL
UNION ALL SELECT 'day', strftime(datetime, '%Y-%m-%d'), count(*) FROM {log} GROUP BY ALL
UNION ALL SELECT 'total_events', 'all', count(*) FROM {log}
UNION ALL SELECT 'total_blocks', 'all', count(DISTINCT block_id) FROM {log}"""


@query(stats_sql(events_sql()))
def dataset_statistics(spark, folder):
    return blocks.dataset_stats(events_log(spark, folder))


@query(stats_sql(ORDER_LOG))
def dataset_statistics_by_order(spark, folder):
    return blocks.dataset_stats(order_log(spark, folder))


@query(f"SELECT min(datetime) AS first_time, max(datetime) AS last_time FROM {events_sql()}")
def dataset_time_range(spark, folder):
    return blocks.date_range(events_log(spark, folder))


@query(f"SELECT block_id, is_error, component_encoded, event_type_encoded, block_size, event_frequency, source_ip_encoded FROM ({features_sql(ORDER_LOG)})")
def features_without_constant_columns(spark, folder):
    """The order log has whole days and no destination address: two constant columns."""
    from loggrove.scratch import written

    features = written(blocks.block_features(order_log(spark, folder)), "features")
    names = [c for c in features.columns if c != "block_id"]
    constant = blocks.constant_columns(features, names)
    return features.select("block_id", *[c for c in names if c not in constant])


