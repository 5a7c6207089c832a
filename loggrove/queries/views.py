"""Report queries over scored blocks, uploads and the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from loggrove.operators import metrics
from loggrove.plans import uploads, views
from loggrove.queries.registry import query
from loggrove.queries.scored import ORDER_BLOCKS, order_blocks
from loggrove.queries.scoring import severity_sql
from loggrove.queries.sqltext import ORDER_LOG
from loggrove.scratch import scratch_path, written
from loggrove.sources.tables import order_log, read_table

UPLOADS = """(SELECT o_custkey % 10 AS upload_id, o_orderdate AS uploaded_at, 'blk_' || (o_custkey + 14000) AS block_id, o_orderdate AS first_seen,
  CAST(floor(o_totalprice) AS DOUBLE) AS block_size, o_orderpriority AS component, o_orderstatus AS event_type, '10.3.0.' || (o_custkey % 50) AS source_ip,
  o_orderkey AS event_frequency, round(o_totalprice / 1000000, 6) AS anomaly_score, CASE WHEN o_totalprice > 400000 THEN 'Anomaly' ELSE 'Normal' END AS predicted_label
  FROM orders)"""
DATASET = f"""(SELECT block_id, first_seen, block_size, component, event_type, source_ip, CAST(NULL AS BIGINT) AS event_frequency, anomaly_score, predicted_label, true_label
  FROM {ORDER_BLOCKS})"""
MERGED = f"""(SELECT block_id, first_seen, block_size, component, event_type, source_ip, event_frequency, anomaly_score, predicted_label, true_label, 'dataset' AS origin FROM {DATASET}
  UNION ALL SELECT block_id, first_seen, block_size, component, event_type, source_ip, event_frequency, anomaly_score, predicted_label, NULL, 'upload' FROM (
    SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY uploaded_at, upload_id, first_seen, block_size) AS r FROM {UPLOADS})
  WHERE r = 1 AND block_id NOT IN (SELECT block_id FROM {ORDER_BLOCKS}))"""
VIEW = severity_sql(MERGED)


def uploaded(spark, folder):
    return read_table(spark, folder, "orders").select(
        (F.col("o_custkey") % 10).alias("upload_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("uploaded_at"),
        F.concat(F.lit("blk_"), F.col("o_custkey") + 14000).alias("block_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("first_seen"),
        F.floor("o_totalprice").cast("double").alias("block_size"), F.col("o_orderpriority").alias("component"),
        F.col("o_orderstatus").alias("event_type"), F.concat(F.lit("10.3.0."), F.col("o_custkey") % 50).alias("source_ip"),
        F.col("o_orderkey").alias("event_frequency"), F.round(F.col("o_totalprice") / 1000000, 6).alias("anomaly_score"),
        F.when(F.col("o_totalprice") > 400000, "Anomaly").otherwise("Normal").alias("predicted_label"))


def dataset(spark, folder):
    """Predictions and metadata of the dataset's blocks, as the view joins them."""
    blocks = order_blocks(spark, folder)
    predictions = blocks.select("block_id", "anomaly_score", "predicted_label", "true_label")
    metadata = blocks.select("block_id", "first_seen", "block_size", "component", "event_type", "source_ip",
                             F.lit(None).cast("bigint").alias("event_frequency"))
    return predictions, metadata


def view(spark, folder):
    predictions, metadata = dataset(spark, folder)
    return written(views.current_predictions(predictions, metadata, uploaded(spark, folder)), "view")


@query(f"SELECT * FROM {VIEW}")
def current_predictions(spark, folder):
    return view(spark, folder)


@query(f"SELECT block_id, origin, anomaly_score, event_frequency FROM {MERGED}")
def uploads_merged(spark, folder):
    predictions, metadata = dataset(spark, folder)
    return uploads.merge_uploads(predictions.join(metadata, "block_id", "left"), uploaded(spark, folder)).select(
        "block_id", "origin", "anomaly_score", "event_frequency")


@query(f"SELECT block_id, anomaly_score, component FROM {VIEW} WHERE severity = 'critical' AND (contains(lower(block_id), 'spec') OR contains(lower(component), 'spec') OR contains(lower(event_type), 'spec') OR contains(lower(source_ip), 'spec'))")
def detections_filtered(spark, folder):
    return views.filter_detections(view(spark, folder), "critical", "SPEC").select("block_id", "anomaly_score", "component")


@query(f"SELECT block_id, anomaly_score, severity FROM {VIEW} ORDER BY anomaly_score DESC, block_id LIMIT 50 OFFSET 100")
def detections_page(spark, folder):
    return views.detections_page(view(spark, folder), page=3, limit=50).select("block_id", "anomaly_score", "severity")


@query(f"SELECT block_id, severity, predicted_label, origin FROM {VIEW} WHERE severity = 'high'")
def detections_exported(spark, folder):
    path = scratch_path(spark, "export")
    views.export_detections(view(spark, folder), path, "high")
    return spark.read.option("header", True).csv(path).select("block_id", "severity", "predicted_label", "origin")


@query(f"""SELECT count(*) AS total_analyzed, count(*) FILTER (predicted_label <> 'Anomaly') AS normal_count, count(*) FILTER (predicted_label = 'Anomaly') AS anomalous_count,
  avg(anomaly_score) AS avg_anomaly_score FROM {MERGED}""")
def detections_summary(spark, folder):
    return views.detections_summary(view(spark, folder))


@query(f"SELECT severity, count(*) AS blocks FROM {VIEW} WHERE predicted_label = 'Anomaly' GROUP BY severity")
def severity_mix(spark, folder):
    return views.severity_mix(view(spark, folder))


@query(f"SELECT block_id, anomaly_score FROM {MERGED} WHERE predicted_label = 'Anomaly' ORDER BY anomaly_score DESC, block_id LIMIT 5")
def recent_anomalies(spark, folder):
    return views.recent_anomalies(view(spark, folder)).select("block_id", "anomaly_score")


@query(f"""SELECT coalesce(l.day, b.day) AS day, coalesce(l.lines, 0) + coalesce(b.up, 0) AS lines, coalesce(b.blocks, 0) AS blocks, coalesce(b.anomalies, 0) AS anomalies FROM
  (SELECT strftime(datetime, '%Y-%m-%d') AS day, count(*) AS lines FROM {ORDER_LOG} GROUP BY ALL) l FULL JOIN
  (SELECT strftime(first_seen, '%Y-%m-%d') AS day, count(*) AS blocks, count(*) FILTER (predicted_label = 'Anomaly') AS anomalies,
    CAST(sum(event_frequency) FILTER (origin = 'upload') AS BIGINT) AS up FROM {MERGED} GROUP BY ALL) b ON l.day = b.day""")
def volume_by_day(spark, folder):
    return views.volume_by_day(order_log(spark, folder), view(spark, folder))


@query(f"""SELECT (SELECT count(*) FROM {ORDER_LOG}) + CAST(sum(event_frequency) FILTER (origin = 'upload') AS BIGINT) AS total_lines_processed, count(*) AS total_blocks_analyzed,
  count(*) FILTER (predicted_label = 'Anomaly') AS anomalies_detected, 100.0 * count(*) FILTER (predicted_label = 'Anomaly') / count(*) AS anomaly_rate_pct,
  (SELECT 100.0 * count(*) FILTER (true_label <> 'Anomaly' AND predicted_label = 'Anomaly') / count(*) FILTER (true_label <> 'Anomaly') FROM {ORDER_BLOCKS}) AS false_positive_rate_pct,
  count(*) FILTER (origin = 'upload') AS uploaded_blocks_added, CAST(sum(event_frequency) FILTER (origin = 'upload') AS BIGINT) AS uploaded_lines_added FROM {MERGED}""")
def dashboard_kpis(spark, folder):
    return views.kpis(order_log(spark, folder), view(spark, folder), metrics.evaluate(order_blocks(spark, folder)))


@query("""SELECT CAST(hour(first) AS INTEGER) AS hour_of_day, count(*) AS blocks FROM (SELECT 'user-' || user_id || '|' || strftime(ts, '%Y%m%dT%H') AS b, min(ts) AS first FROM events GROUP BY b) GROUP BY ALL""")
def blocks_by_hour_of_day(spark, folder):
    from loggrove.operators.blocks import block_metadata
    from loggrove.sources.tables import events_log

    blocks = block_metadata(events_log(spark, folder, "identity_hour"))
    return views.hours_of_day(blocks.select(F.hour("first_seen").alias("hour_of_day")))


@query(f"""SELECT strftime(first_seen, '%Y-%m-%d') AS day, count(*) FILTER (predicted_label = 'Anomaly') AS anomalies, count(*) FILTER (predicted_label = 'Normal') AS normal
FROM {MERGED} GROUP BY ALL""")
def anomalies_by_day(spark, folder):
    return views.anomalies_by_day(view(spark, folder))


@query(f"""SELECT strftime(first_seen, '%Y-%m-%d') AS day, component, count(*) AS anomalies FROM {MERGED} WHERE predicted_label = 'Anomaly'
  AND component IN (SELECT component FROM {ORDER_LOG} GROUP BY component ORDER BY count(*) DESC, component LIMIT 3) GROUP BY ALL""")
def anomalies_by_component_and_day(spark, folder):
    return views.anomalies_by_component_and_day(order_log(spark, folder), view(spark, folder), 3)


@query(f"SELECT component AS name, count(*) AS n FROM {ORDER_LOG} GROUP BY component ORDER BY n DESC, name LIMIT 3")
def top_components(spark, folder):
    return views.top_values(order_log(spark, folder), "component", 3)


@query(f"""SELECT upload_id, count(*) AS blocks_analyzed, count(*) FILTER (predicted_label = 'Anomaly') AS anomalies_detected,
  round(100.0 * count(*) FILTER (predicted_label = 'Anomaly') / count(*), 2) AS anomaly_rate_pct FROM {UPLOADS} GROUP BY upload_id""")
def upload_result_counts(spark, folder):
    return uploads.result_counts(uploaded(spark, folder), ["upload_id"])
