"""Alert metrics, lead time and the choice of k over prefix rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loggrove.operators import metrics
from loggrove.operators.prefix import prefix_features
from loggrove.queries.arrival_level import prefix_sql
from loggrove.queries.registry import query
from loggrove.queries.scored import USER_BLOCKS, user_blocks
from loggrove.queries.scoring import ratio
from loggrove.queries.sqltext import events_log as events_sql
from loggrove.schema import ANOMALY, PREFIX_LENGTHS
from loggrove.scratch import written
from loggrove.sources.tables import events_log


def alerts(spark, folder):
    """Prefix rows with a simple alert rule: a third of the prefix are errors."""
    rows = prefix_features(events_log(spark, folder), PREFIX_LENGTHS)
    labels = user_blocks(spark, folder).select("block_id", "true_label")
    return written(rows.join(labels, "block_id").select(
        "block_id", "k", "total_events", (F.col("error_count") * 3 >= F.col("n_events")).alias("alert"),
        (F.col("true_label") == ANOMALY).alias("is_anomaly"),
        metrics.lead_fraction(F.col("total_events"), F.col("k")).alias("lead"),
        F.greatest(F.col("block_end_seconds") - F.col("prefix_end_seconds"), F.lit(0)).alias("lead_seconds")), "alerts")


ALERTS = f"""(SELECT p.block_id, k, total_events, error_count * 3 >= n_events AS alert, true_label = 'Anomaly' AS is_anomaly,
  CASE WHEN total_events > 0 THEN (total_events - least(total_events, k)) / total_events ELSE 0.0 END AS lead,
  greatest(block_end_seconds - prefix_end_seconds, 0) AS lead_seconds FROM ({prefix_sql(events_sql(), PREFIX_LENGTHS, False)}) p JOIN {USER_BLOCKS} b USING (block_id))"""


def alert_sql(source: str) -> str:
    hit = "FILTER (alert AND is_anomaly)"
    return f"""(SELECT k, tp, fp, fn, tn, {ratio('tp', 'tp + fp')} AS "precision", {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1,
      {ratio('fp', 'fp + tn')} AS false_alarm_rate, {ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy, tp + fp AS alerts,
      coalesce(mean_lead, 0.0) AS mean_lead, coalesce(median_lead, 0.0) AS median_lead, coalesce(share_before_end, 0.0) AS share_before_end,
      {ratio('coalesce(lead_sum, 0.0)', 'tp + fp')} AS expected_lead_per_alert, mean_lead_seconds, median_lead_seconds FROM (
      SELECT k, count(*) {hit} AS tp, count(*) FILTER (alert AND NOT is_anomaly) AS fp, count(*) FILTER (NOT alert AND is_anomaly) AS fn,
        count(*) FILTER (NOT alert AND NOT is_anomaly) AS tn, avg(lead) {hit} AS mean_lead, median(lead) {hit} AS median_lead, sum(lead) {hit} AS lead_sum,
        avg(CASE WHEN lead > 0 THEN 1.0 ELSE 0.0 END) {hit} AS share_before_end, avg(lead_seconds) {hit} AS mean_lead_seconds,
        median(lead_seconds) {hit} AS median_lead_seconds FROM {source} GROUP BY k))"""


@query(f"SELECT * FROM {alert_sql(ALERTS)}")
def alert_quality_per_prefix_length(spark, folder):
    return metrics.alert_metrics(alerts(spark, folder), ["k"])


@query(f"SELECT * FROM {alert_sql(f'(SELECT * FROM {ALERTS} WHERE total_events > k)')}")
def alert_quality_on_running_blocks(spark, folder):
    rows = alerts(spark, folder)
    return metrics.alert_metrics(rows.where(F.col("total_events") > F.col("k")), ["k"])


@query(f"""WITH p AS (SELECT k, "precision", mean_lead, expected_lead_per_alert FROM {alert_sql(ALERTS)}),
  f AS (SELECT *, NOT EXISTS (SELECT 1 FROM p o WHERE o.k <> p.k AND o."precision" >= p."precision" AND o.mean_lead >= p.mean_lead
    AND (o."precision" > p."precision" OR o.mean_lead > p.mean_lead)) AS on_pareto_front FROM p)
SELECT *, on_pareto_front AND row_number() OVER (ORDER BY on_pareto_front DESC, expected_lead_per_alert DESC, k) = 1 AS is_best FROM f""")
def best_prefix_length(spark, folder):
    points = metrics.alert_metrics(alerts(spark, folder), ["k"]).select("k", "precision", "mean_lead", "expected_lead_per_alert")
    return metrics.pareto_front(points, "k", "precision", "mean_lead", "expected_lead_per_alert")


@query(f"""SELECT k, count(*) AS blocks, count(*) FILTER (alert) AS alerts, count(*) FILTER (total_events <= k) AS shorter_than_k FROM {ALERTS} GROUP BY k""")
def early_warning_summary(spark, folder):
    return alerts(spark, folder).groupBy("k").agg(
        F.count("*").alias("blocks"), F.count_if("alert").alias("alerts"), F.count_if(F.col("total_events") <= F.col("k")).alias("shorter_than_k"))
