"""Rule labels, label joins, analyst feedback, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from loggrove.operators import audit, labels, sampling
from loggrove.plans.views import list_feedback
from loggrove.queries import rendered
from loggrove.queries.registry import query
from loggrove.queries.scored import ORDER_BLOCKS, USER_BLOCKS, order_blocks, user_blocks
from loggrove.queries.sqltext import ORDER_LOG, events_log as events_sql
from loggrove.scratch import scratch_path
from loggrove.sources.registry import parse
from loggrove.sources.cloudtrail import RECORD_SCHEMA
from loggrove.sources.tables import events_log, order_log, read_table

AUDIT = f"({rendered.AUDIT_SQL})"
PREFIXES = "|".join(labels.SENSITIVE_PREFIXES)
ACTIONS = ", ".join(f"'{a}'" for a in labels.SENSITIVE_STORAGE_ACTIONS)
SENSITIVE = f"""((component = 'iam.amazonaws.com' AND regexp_matches(event_type, '^(?:{PREFIXES})'))
  OR (component = 's3.amazonaws.com' AND event_type IN ({ACTIONS})))"""
# Rules with a burst of 2, because a rendered identity-hour rarely has ten errors.
WEAK = f"""(WITH rows AS (SELECT block_id, source_ip, date || ' ' || time AS t, string_split(block_id, '|')[-1] AS hour,
    regexp_matches(raw_message, 'errorCode=AccessDenied') AS auth, {SENSITIVE} AS sensitive FROM {AUDIT}),
  firsts AS (SELECT source_ip, arg_min(hour, t) AS first_hour FROM rows GROUP BY source_ip),
  per AS (SELECT block_id, count(*) FILTER (auth) AS auth_errors, count(*) FILTER (sensitive AND hour = first_hour) AS new_address_actions
    FROM rows JOIN firsts USING (source_ip) GROUP BY block_id)
  SELECT block_id, CASE WHEN auth_errors >= 2 OR new_address_actions > 0 THEN 'Anomaly' ELSE 'Normal' END AS label,
    auth_errors >= 2 AS rule_auth_error_burst, new_address_actions > 0 AS rule_new_address_sensitive, auth_errors, new_address_actions FROM per)"""


def audit_log(spark, folder):
    records = rendered.audit_records(spark, folder).withColumn("record", F.from_json("value", RECORD_SCHEMA)).drop("value")
    parsed = parse(records, "cloudtrail")
    return parsed.withColumn("datetime", F.try_to_timestamp(F.concat_ws(" ", "date", "time")).cast("timestamp_ntz"))


def weak(spark, folder):
    return labels.weak_labels(audit_log(spark, folder), burst=2)


@query(f"SELECT * FROM {WEAK}")
def weak_rule_labels(spark, folder):
    return weak(spark, folder)


@query(f"""SELECT block_id, count(*) FILTER (regexp_matches(raw_message, 'errorCode=AccessDenied')) >= 10 AS burst FROM (
  SELECT source_ip AS block_id, raw_message FROM {AUDIT}) GROUP BY block_id""")
def auth_error_bursts(spark, folder):
    """The burst rule alone at its usual size, with the caller's address as the block."""
    rows = audit_log(spark, folder)
    return rows.groupBy(F.col("source_ip").alias("block_id")).agg(
        (F.count_if(labels.auth_error(F.col("raw_message"))) >= labels.AUTH_ERROR_BURST).alias("burst"))


@query(f"""SELECT count(*) AS blocks, count(*) FILTER (rule_auth_error_burst) AS auth_error_burst,
  count(*) FILTER (rule_new_address_sensitive) AS new_address_sensitive, count(*) FILTER (rule_auth_error_burst AND rule_new_address_sensitive) AS both,
  count(*) FILTER (label = 'Anomaly') AS anomalies FROM {WEAK}""")
def weak_rule_counts(spark, folder):
    return labels.rule_counts(weak(spark, folder))


@query(f"SELECT component, event_type, {SENSITIVE} AS sensitive, count(*) AS lines FROM {AUDIT} GROUP BY ALL")
def sensitive_actions(spark, folder):
    rows = audit_log(spark, folder)
    return rows.groupBy("component", "event_type", labels.is_sensitive(F.col("component"), F.col("event_type")).alias("sensitive")).agg(
        F.count("*").alias("lines"))


@query("""SELECT DISTINCT 'b9000564-fe1a-409b-b8cc-' || lpad(lower(to_hex(user_id)), 12, '0') AS block_id FROM events
WHERE event_type = 'error'""")
def ids_in_label_text(spark, folder):
    """Ids read out of sentences."""
    uuid = F.concat(F.lit("b9000564-fe1a-409b-b8cc-"), F.lower(F.lpad(F.hex("user_id"), 12, "0")))
    text = read_table(spark, folder, "events").where("event_type = 'error'").select(
        F.concat(F.lit("injected into instance "), uuid, F.lit("\r\n")).alias("value"))
    return labels.ids_in_text(text)


OPENSTACK = f"({rendered.OPENSTACK_SQL.replace('{request}', 'FALSE')})"


@query(f"""SELECT block_id, CASE WHEN block_id IN (SELECT block_id FROM {OPENSTACK} WHERE log_level = 'ERROR') THEN 'Anomaly' ELSE 'Normal' END AS label
FROM (SELECT DISTINCT block_id FROM {OPENSTACK} WHERE block_id IS NOT NULL)""")
def labels_by_membership(spark, folder):
    """A session is anomalous iff the file of abnormal lines mentions it."""
    lines = rendered.openstack_lines(spark, folder)
    sessions = labels.sessions_in_text(lines)
    abnormal = labels.sessions_in_text(lines.where(F.col("value").contains(" ERROR ")))
    return labels.membership_labels(sessions, abnormal)


@query("""SELECT 'blk_' || o_orderkey AS block_id, CASE WHEN o_orderstatus = 'F' THEN 'Anomaly' ELSE 'Normal' END AS label FROM orders""")
def labels_from_csv(spark, folder):
    path = scratch_path(spark, "labels")
    read_table(spark, folder, "orders").select(
        F.concat(F.lit("blk_"), "o_orderkey").alias("BlockId"),
        F.when(F.col("o_orderstatus") == "F", "Anomaly").otherwise("Normal").alias("Label")).write.option("header", True).csv(path)
    return labels.read_labels(spark, path)


# Labels exist only for orders with a status; the order table lacks some line items' orders and the reverse.
ORDER_LABELS = """(SELECT 'blk_' || o_orderkey AS block_id, CASE WHEN o_orderstatus = 'F' THEN 'Anomaly' ELSE 'Normal' END AS label
  FROM orders WHERE o_orderstatus <> 'P')"""


def order_labels(spark, folder):
    return read_table(spark, folder, "orders").where("o_orderstatus <> 'P'").select(
        F.concat(F.lit("blk_"), "o_orderkey").alias("block_id"),
        F.when(F.col("o_orderstatus") == "F", "Anomaly").otherwise("Normal").alias("label"))


def order_sizes(spark, folder):
    return order_log(spark, folder).groupBy("block_id").agg(F.count("*").alias("event_frequency"))


SIZES = f"(SELECT block_id, count(*) AS event_frequency FROM {ORDER_LOG} GROUP BY block_id)"


@query(f"SELECT s.*, l.label FROM {SIZES} s JOIN {ORDER_LABELS} l USING (block_id)")
def features_with_labels(spark, folder):
    return labels.labeled_only(order_sizes(spark, folder), order_labels(spark, folder))


@query(f"""SELECT s.*, coalesce(l.label, 'Normal') AS label, l.label IS NULL AS label_missing FROM {SIZES} s LEFT JOIN {ORDER_LABELS} l USING (block_id)""")
def labels_with_default(spark, folder):
    return labels.attach_labels(order_sizes(spark, folder), order_labels(spark, folder))


# Analyst verdicts: each signup or error event is a verdict on its user's block; some users are outside the log's hour blocks.
FEEDBACK = """(SELECT 'django' AS source, 'user-' || (user_id * 2) AS block_id, CASE event_type WHEN 'error' THEN 'anomaly' ELSE 'normal' END AS verdict, ts AS "at"
  FROM events WHERE event_type IN ('error', 'signup'))"""
LATEST = f"""(SELECT source, block_id, arg_max(upper(verdict[1]) || verdict[2:], "at") AS verdict, max("at") AS "at" FROM {FEEDBACK} GROUP BY source, block_id)"""


def feedback(spark, folder):
    return read_table(spark, folder, "events").where(F.col("event_type").isin("error", "signup")).select(
        F.lit("django").alias("source"), F.concat(F.lit("user-"), F.col("user_id") * 2).alias("block_id"),
        F.when(F.col("event_type") == "error", "anomaly").otherwise("normal").alias("verdict"), F.col("ts").alias("at"))


@query(f"SELECT * FROM {LATEST}")
def latest_verdicts(spark, folder):
    return labels.latest_verdicts(feedback(spark, folder))


@query(f"""SELECT b.block_id, b.true_label AS previous_label, coalesce(v.verdict, b.true_label) AS label, v.verdict FROM {USER_BLOCKS} b LEFT JOIN {LATEST} v USING (block_id)""")
def feedback_overrides(spark, folder):
    labeled = user_blocks(spark, folder).select("block_id", F.col("true_label").alias("label"))
    return labels.apply_feedback(labeled, labels.latest_verdicts(feedback(spark, folder)))


@query(f"""SELECT count(*) FILTER (b.block_id IS NOT NULL AND v.verdict IS NOT NULL) AS applied,
  count(*) FILTER (b.true_label <> v.verdict) AS changed, count(*) FILTER (b.block_id IS NOT NULL AND v.verdict = 'Anomaly') AS confirmed_anomalies,
  count(*) FILTER (b.block_id IS NOT NULL AND v.verdict = 'Normal') AS marked_normal, count(*) FILTER (b.block_id IS NULL) AS outside_dataset
FROM {USER_BLOCKS} b FULL JOIN {LATEST} v USING (block_id)""")
def feedback_effect(spark, folder):
    labeled = user_blocks(spark, folder).select("block_id", F.col("true_label").alias("label"))
    return labels.feedback_counts(labeled, labels.latest_verdicts(feedback(spark, folder)))


@query(f"SELECT verdict, count(*) AS n FROM {LATEST} GROUP BY verdict")
def feedback_listing_counts(spark, folder):
    return labels.latest_verdicts(feedback(spark, folder)).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""SELECT * FROM {LATEST} WHERE source = 'django' ORDER BY "at" DESC, block_id LIMIT 500""")
def feedback_listing(spark, folder):
    return list_feedback(labels.latest_verdicts(feedback(spark, folder)), "django")


FAULTY = "(SELECT DISTINCT 'user-' || user_id AS block_id FROM events WHERE event_type = 'error' AND value > 300)"


@query(f"""SELECT count(*) FILTER (f.block_id IS NOT NULL) AS faulty_present, count(*) FILTER (f.block_id IS NOT NULL AND predicted_label = 'Anomaly') AS faulty_caught,
  count(*) FILTER (predicted_label = 'Anomaly') AS flagged_overall FROM {USER_BLOCKS} b LEFT JOIN {FAULTY} f USING (block_id)""")
def faulty_blocks_caught(spark, folder):
    faulty = read_table(spark, folder, "events").where("event_type = 'error' and value > 300").select(
        F.concat(F.lit("user-"), "user_id").alias("block_id")).distinct()
    return labels.faulty_check(user_blocks(spark, folder), faulty)


@query(f"""SELECT block_id, count(*) AS lines FROM {events_sql()} WHERE block_id IN (SELECT block_id FROM {USER_BLOCKS} WHERE predicted_label = 'Anomaly') GROUP BY block_id""")
def lines_of_flagged_blocks(spark, folder):
    flagged = user_blocks(spark, folder).where("predicted_label = 'Anomaly'")
    return sampling.lines_of_blocks(events_log(spark, folder), flagged).groupBy("block_id").agg(F.count("*").alias("lines"))


def split_sql(share: float, seed: str = "42", blocks: str = ORDER_BLOCKS) -> str:
    return f"""(SELECT *, CASE WHEN row_number() OVER (PARTITION BY true_label ORDER BY md5('{seed}:' || block_id), block_id)
      <= floor({share} * count(*) OVER (PARTITION BY true_label) + 0.5) THEN 'test' ELSE 'train' END AS split FROM {blocks})"""


@query(f"SELECT block_id, true_label, split FROM {split_sql(0.3)}")
def stratified_split_70_30(spark, folder):
    blocks = order_blocks(spark, folder)
    return sampling.stratified_split(blocks, 0.3, label="true_label").select("block_id", "true_label", "split")


@query(f"""SELECT block_id, true_label, CAST((row_number() OVER (PARTITION BY true_label ORDER BY md5('42:' || block_id), block_id) - 1) % 5 AS INTEGER) AS fold FROM {ORDER_BLOCKS}""")
def stratified_folds(spark, folder):
    return sampling.folds(order_blocks(spark, folder), 5, label="true_label").select("block_id", "true_label", "fold")


@query(f"""SELECT block_id, true_label FROM (SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY md5('42:' || block_id), block_id) AS r,
  count(*) OVER (PARTITION BY true_label) AS n, count(*) OVER () AS total FROM {ORDER_BLOCKS}) WHERE r <= floor(CAST(500 * n AS DOUBLE) / total + 0.5)""")
def stratified_subsample(spark, folder):
    return sampling.stratified_sample(order_blocks(spark, folder), 500, label="true_label").select("block_id", "true_label")


@query(f"SELECT block_id, event_frequency FROM {SIZES} ORDER BY md5('7:' || block_id), block_id LIMIT 200")
def unlabeled_sample(spark, folder):
    return sampling.unlabeled_sample(order_sizes(spark, folder), 200, seed=7)


@query(f"""SELECT block_id, first_seen, CASE WHEN row_number() OVER (ORDER BY first_seen, block_id) <= count(*) OVER () // 2 THEN 'early' ELSE 'late' END AS half FROM {ORDER_BLOCKS}""")
def early_and_late_halves(spark, folder):
    return sampling.time_halves(order_blocks(spark, folder)).select("block_id", "first_seen", "half")


AUDITED = f"(SELECT block_id, event_frequency, block_size, is_error, errors, 1 AS always FROM {ORDER_BLOCKS})"


@query(f"""WITH f AS {AUDITED}, l AS {ORDER_LABELS}, j AS (SELECT * FROM f JOIN l USING (block_id))
SELECT 'duplicate_feature_ids' AS "check", CAST(count(*) - count(DISTINCT block_id) AS DOUBLE) AS value, count(*) <> count(DISTINCT block_id) AS flagged FROM f
UNION ALL SELECT 'duplicate_label_ids', CAST(count(*) - count(DISTINCT block_id) AS DOUBLE), count(*) <> count(DISTINCT block_id) FROM l
UNION ALL SELECT 'rows_lost_in_join_pct', 100.0 * ((SELECT count(*) FROM f) - count(*)) / (SELECT count(*) FROM f), 100.0 * ((SELECT count(*) FROM f) - count(*)) / (SELECT count(*) FROM f) > 1.0 FROM j
UNION ALL SELECT 'share_pct:' || label, 100.0 * count(*) / (SELECT count(*) FROM j), FALSE FROM j GROUP BY label
UNION ALL SELECT 'nulls:' || c, 0.0, FALSE FROM (SELECT unnest(['event_frequency', 'block_size', 'is_error', 'errors', 'always']) AS c)
UNION ALL SELECT 'constant:' || c, CASE WHEN c = 'always' THEN 1.0 ELSE 0.0 END, c = 'always' FROM (SELECT unnest(['event_frequency', 'block_size', 'is_error', 'errors', 'always']) AS c)""")
def readiness_audit(spark, folder):
    features = order_blocks(spark, folder).select("block_id", "event_frequency", "block_size", "is_error", "errors", F.lit(1).alias("always"))
    return audit.readiness(features, order_labels(spark, folder))


@query(f"""SELECT s.block_id, s.event_frequency, b.anomaly_score FROM {SIZES} s JOIN {ORDER_BLOCKS} b USING (block_id)""")
def scores_joined_without_loss(spark, folder):
    scores = order_blocks(spark, folder).select("block_id", "anomaly_score")
    return audit.join_without_loss(order_sizes(spark, folder), scores, "block_id")
