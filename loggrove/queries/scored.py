"""Scored and labeled blocks made from the tables by a plain formula, for the
operators that only need a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loggrove.operators.ordering import exact_quantiles
from loggrove.queries.sqltext import ORDER_LOG, events_log as events_sql
from loggrove.schema import ANOMALY, NORMAL
from loggrove.scratch import written
from loggrove.sources.tables import events_log, order_log


def scored(log: DataFrame, anomalous_errors: int) -> DataFrame:
    """block_id, score, labels, size, frequency; flagged above the 0.9 quantile."""
    blocks = log.groupBy("block_id").agg(
        F.count("*").alias("event_frequency"), F.count_if(F.col("log_level") == "ERROR").alias("errors"),
        F.max(F.coalesce(F.col("block_size").cast("double"), F.lit(0.0))).alias("block_size"),
        F.min("datetime").alias("first_seen"), F.max("datetime").alias("last_seen"),
        F.min("component").alias("component"), F.min("event_type").alias("event_type"), F.min("source_ip").alias("source_ip"))
    share = F.col("errors") / F.col("event_frequency")
    blocks = blocks.withColumns({
        "anomaly_score": F.round(0.6 * share + 0.4 * F.log1p("event_frequency") / 10, 6),
        "is_error": (F.col("errors") > 0).cast("int"),
        "true_label": F.when(F.col("errors") >= anomalous_errors, ANOMALY).otherwise(NORMAL)})
    blocks = written(blocks, "scored")
    cut = exact_quantiles(blocks, "anomaly_score", [0.9])[0]
    return blocks.withColumn("predicted_label", F.when(F.col("anomaly_score") > cut, ANOMALY).otherwise(NORMAL))


def order_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return scored(order_log(spark, folder), 2)


def user_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return scored(events_log(spark, folder), 18)


def scored_sql(log: str, anomalous_errors: int) -> str:
    return f"""(SELECT *, CASE WHEN anomaly_score > quantile_cont(anomaly_score, 0.9) OVER () THEN 'Anomaly' ELSE 'Normal' END AS predicted_label FROM (
      SELECT block_id, count(*) AS event_frequency, count(*) FILTER (log_level = 'ERROR') AS errors, max(coalesce(CAST(block_size AS DOUBLE), 0.0)) AS block_size,
        min(datetime) AS first_seen, max(datetime) AS last_seen, min(component) AS component, min(event_type) AS event_type, min(source_ip) AS source_ip,
        round(CAST(0.6 AS DOUBLE) * (count(*) FILTER (log_level = 'ERROR') / count(*)) + CAST(0.4 AS DOUBLE) * ln(1 + count(*)) / 10, 6) AS anomaly_score,
        CAST(CASE WHEN count(*) FILTER (log_level = 'ERROR') > 0 THEN 1 ELSE 0 END AS INTEGER) AS is_error,
        CASE WHEN count(*) FILTER (log_level = 'ERROR') >= {anomalous_errors} THEN 'Anomaly' ELSE 'Normal' END AS true_label
      FROM {log} GROUP BY block_id))"""


ORDER_BLOCKS = scored_sql(ORDER_LOG, 2)
USER_BLOCKS = scored_sql(events_sql(), 18)
