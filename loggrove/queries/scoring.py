"""Metrics, severity and thresholds over scored blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loggrove.operators import metrics, sampling
from loggrove.queries.labeling import split_sql
from loggrove.queries.registry import query
from loggrove.queries.scored import ORDER_BLOCKS, USER_BLOCKS, order_blocks, user_blocks
from loggrove.scratch import written

COUNTS = """count(*) FILTER (true_label = 'Anomaly' AND predicted_label = 'Anomaly') AS tp, count(*) FILTER (true_label <> 'Anomaly' AND predicted_label = 'Anomaly') AS fp,
  count(*) FILTER (true_label = 'Anomaly' AND predicted_label <> 'Anomaly') AS fn, count(*) FILTER (true_label <> 'Anomaly' AND predicted_label <> 'Anomaly') AS tn"""


def ratio(a: str, b: str, empty: str = "0.0") -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE {empty} END"


def evaluate_sql(blocks: str, extra: str = "") -> str:
    return f"""SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0.0 END AS f1 FROM (
      SELECT *, {ratio('tp + tn', 'support_total')} AS accuracy, {ratio('tp', 'tp + fp')} AS "precision", {ratio('tp', 'tp + fn')} AS recall,
        {ratio('fp', 'fp + tn')} AS false_positive_rate, {ratio('fn', 'fn + tp')} AS false_negative_rate, {ratio('fp + fn', 'support_total')} AS error_rate
      FROM (SELECT {extra}{COUNTS}, count(*) AS support_total, count(*) FILTER (true_label = 'Normal') AS support_normal,
        count(*) FILTER (true_label = 'Anomaly') AS support_anomaly FROM {blocks} {'GROUP BY ALL' if extra else ''}))"""


@query(evaluate_sql(ORDER_BLOCKS))
def evaluation(spark, folder):
    return metrics.evaluate(order_blocks(spark, folder))


@query(evaluate_sql(split_sql(0.3), "split, "))
def train_and_test_gap(spark, folder):
    return metrics.evaluate(sampling.stratified_split(order_blocks(spark, folder), 0.3, label="true_label"), ["split"])


def severity_sql(blocks: str) -> str:
    return f"""(WITH b AS {blocks}, cuts AS (SELECT quantile_cont(anomaly_score, [CAST(1 AS DOUBLE) / 3, CAST(2 AS DOUBLE) / 3]) AS q FROM b WHERE predicted_label = 'Anomaly')
      SELECT b.*, CASE WHEN predicted_label <> 'Anomaly' THEN 'normal' WHEN anomaly_score >= q[2] THEN 'critical' WHEN anomaly_score >= q[1] THEN 'high' ELSE 'medium' END AS severity
      FROM b, cuts)"""


@query(f"SELECT block_id, anomaly_score, predicted_label, severity FROM {severity_sql(ORDER_BLOCKS)}")
def severity_tertiles(spark, folder):
    return metrics.with_severity(order_blocks(spark, folder)).select("block_id", "anomaly_score", "predicted_label", "severity")


@query(f"""SELECT block_id, anomaly_score - cut AS anomaly_score, CASE WHEN anomaly_score > cut THEN 'Anomaly' ELSE 'Normal' END AS predicted_label FROM (
  SELECT block_id, anomaly_score, -quantile_cont(-anomaly_score, 0.05) OVER () AS cut FROM {ORDER_BLOCKS})""")
def labels_at_contamination(spark, folder):
    raw = order_blocks(spark, folder).select("block_id", F.col("anomaly_score").alias("score"))
    cut = metrics.contamination_cut(raw, 0.05)
    return metrics.predict_at(raw, cut).select("block_id", "anomaly_score", "predicted_label")


FEATURES = ("event_frequency", "block_size", "is_error", "errors", "anomaly_score")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS feature, CASE WHEN count(DISTINCT {c}) < 2 THEN 0.5 ELSE round(greatest(a, 1 - a), 4) END AS separability FROM (
  SELECT {c}, (sum(r) FILTER (true_label = 'Anomaly') OVER () - pos * (pos + 1) / 2.0) / (pos * neg) AS a FROM (
    SELECT {c}, true_label, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r,
      count(*) FILTER (true_label = 'Anomaly') OVER () AS pos, count(*) FILTER (true_label <> 'Anomaly') OVER () AS neg FROM {ORDER_BLOCKS})) GROUP BY a""" for c in FEATURES))
def single_feature_separability(spark, folder):
    return metrics.separability(order_blocks(spark, folder), list(FEATURES), F.col("true_label") == "Anomaly")


SPLIT = split_sql(0.3)
GRID = ", ".join(f"CAST({0.90 + (0.999 - 0.90) * i / 199!r} AS DOUBLE)" for i in range(200))


def _at(name: str, threshold: str) -> str:
    return f"""SELECT '{name}' AS operating_point, {threshold} AS threshold, count(*) FILTER (anomaly_score > {threshold} AND true_label = 'Anomaly') AS tp,
      count(*) FILTER (anomaly_score > {threshold}) AS flagged, count(*) FILTER (true_label = 'Anomaly') AS positives FROM test"""


@query(f"""WITH s AS MATERIALIZED {SPLIT}, train AS (SELECT * FROM s WHERE split = 'train'), test AS (SELECT * FROM s WHERE split = 'test'),
  cuts AS (SELECT DISTINCT unnest(quantile_cont(anomaly_score, [{GRID}])) AS t FROM train),
  scored AS (SELECT t, 2.0 * count(*) FILTER (anomaly_score > t AND true_label = 'Anomaly') / nullif(count(*) FILTER (anomaly_score > t) + count(*) FILTER (true_label = 'Anomaly'), 0) AS f
    FROM train, cuts GROUP BY t),
  best AS (SELECT t FROM scored ORDER BY round(f, 12) DESC, t LIMIT 1), same AS (SELECT quantile_cont(anomaly_score, 0.97) AS t FROM train),
  points AS ({_at('same_alert_rate', '(SELECT t FROM same)')} UNION ALL {_at('train_best_f1', '(SELECT t FROM best)')}),
  ranks AS (SELECT true_label, rank() OVER (ORDER BY anomaly_score) + (count(*) OVER (PARTITION BY anomaly_score) - 1) / 2.0 AS r FROM test),
  auc AS (SELECT (sum(r) FILTER (true_label = 'Anomaly') - count(*) FILTER (true_label = 'Anomaly') * (count(*) FILTER (true_label = 'Anomaly') + 1) / 2.0)
    / (count(*) FILTER (true_label = 'Anomaly') * count(*) FILTER (true_label <> 'Anomaly')) AS roc_auc FROM ranks)
SELECT 'anomaly_score' AS detector, operating_point, threshold, tp, flagged, positives, roc_auc, {ratio('tp', 'flagged')} AS "precision", {ratio('tp', 'positives')} AS recall,
  {ratio('2 * tp', 'flagged + positives')} AS f1 FROM points, auc""")
def detector_comparison(spark, folder):
    split = written(sampling.stratified_split(order_blocks(spark, folder), 0.3, label="true_label"), "split")
    return metrics.compare_detectors(sampling.side(split, "train"), sampling.side(split, "test"), ["anomaly_score"],
                                     F.col("true_label") == "Anomaly", 0.03)


@query(f"""SELECT threshold, f1 AS train_f1, tp, alerts FROM (SELECT t AS threshold, count(*) FILTER (anomaly_score >= t AND true_label = 'Anomaly') AS tp,
    count(*) FILTER (anomaly_score >= t) AS alerts, 2.0 * count(*) FILTER (anomaly_score >= t AND true_label = 'Anomaly')
      / (count(*) FILTER (anomaly_score >= t) + count(*) FILTER (true_label = 'Anomaly')) AS f1
  FROM {ORDER_BLOCKS}, (SELECT DISTINCT anomaly_score AS t FROM {ORDER_BLOCKS} WHERE anomaly_score >= (SELECT quantile_cont(anomaly_score, 0.5) FROM {ORDER_BLOCKS})
    AND anomaly_score <= (SELECT quantile_cont(anomaly_score, 0.9995) FROM {ORDER_BLOCKS})) GROUP BY t) ORDER BY round(f1, 12) DESC, threshold DESC LIMIT 1""")
def tuned_alert_threshold(spark, folder):
    return metrics.tune_threshold(order_blocks(spark, folder), "anomaly_score", F.col("true_label") == "Anomaly")


@query(f"""SELECT anomaly_score AS cut, sum(count(*) FILTER (true_label = 'Anomaly')) OVER w::BIGINT AS tp, sum(count(*)) OVER w::BIGINT AS alerts,
  CASE WHEN sum(count(*) FILTER (true_label = 'Anomaly')) OVER w > 0 THEN 2.0 * (sum(count(*) FILTER (true_label = 'Anomaly')) OVER w)
   / (sum(count(*)) OVER w + (SELECT count(*) FROM {USER_BLOCKS} WHERE true_label = 'Anomaly')) ELSE 0.0 END AS f1
FROM {USER_BLOCKS} GROUP BY anomaly_score WINDOW w AS (ORDER BY anomaly_score DESC)""")
def f1_at_every_cut(spark, folder):
    return metrics.cut_curve(user_blocks(spark, folder), "anomaly_score", F.col("true_label") == "Anomaly")
