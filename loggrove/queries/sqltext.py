"""SQL fragments shared by the equivalent SQL texts."""

EVENTS_K = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def events_log(block: str = "user") -> str:
    blocks = {
        "user": "'user-' || user_id",
        "identity_hour": "'user-' || user_id || '|' || strftime(ts, '%Y%m%dT%H')",
        "window": "'win-' || strftime(time_bucket(INTERVAL '60 seconds', ts), '%Y%m%dT%H%M%S')",
    }
    return f"""(SELECT event_id AS arrival_seq, date_trunc('second', ts) AS datetime, {blocks[block]} AS block_id,
      CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS log_level,
      'svc-' || (k % 5) AS component, event_type,
      '10.0.' || (user_id % 7) || '.' || (k % 20) AS source_ip,
      CASE WHEN event_type = 'purchase' THEN '10.1.0.' || (k % 10) END AS destination_ip,
      CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS block_size,
      event_type || ' k=' || k AS raw_message FROM {EVENTS_K})"""


ORDER_LOG = """(SELECT l_shipdate AS datetime, 'blk_' || l_orderkey AS block_id,
      CASE WHEN l_discount >= 0.095 THEN 'ERROR' WHEN l_tax >= 0.075 THEN 'WARN' ELSE 'INFO' END AS log_level,
      'svc-' || (l_suppkey % 7) AS component, l_returnflag || l_linestatus AS event_type,
      '10.2.0.' || (l_partkey % 50) AS source_ip, CAST(NULL AS VARCHAR) AS destination_ip,
      CAST(floor(l_quantity) AS BIGINT) AS block_size FROM lineitem)"""


def known(column: str) -> str:
    return f"CASE WHEN {column} IS NULL OR trim({column}) IN ('', '<NA>') THEN 'UNKNOWN' ELSE trim({column}) END"


def dominant(log: str, column: str, value: str, tie: str) -> str:
    """(block_id, value) with the highest count; ties to the smallest ``tie``."""
    return f"""(SELECT block_id, {value} AS {column} FROM (
        SELECT block_id, {value}, row_number() OVER (PARTITION BY block_id ORDER BY count(*) DESC, {tie}) AS rn
        FROM {log} GROUP BY block_id, {value}) WHERE rn = 1)"""
