"""Streaming operators over the event table, and reports on finished runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loggrove.operators import forest as forests
from loggrove.operators.clean import coerce, drop_invalid, known, recognized
from loggrove.operators.forest import ForestParams
from loggrove.operators.prefix import prefix_features
from loggrove.operators.retention import Normalizer, Policy
from loggrove.operators.vocab import append_codes
from loggrove.operators.blocks import block_features
from loggrove.plans.early_warning import train_early_warning
from loggrove.queries.arrival_level import EVENT_TYPES, prefix_sql
from loggrove.queries.block_level import features_sql
from loggrove.queries.registry import query
from loggrove.queries.rendered import HDFS_SQL, hdfs_lines
from loggrove.queries.scored import USER_BLOCKS, user_blocks
from loggrove.queries.scoring import ratio
from loggrove.queries.sqltext import events_log as events_sql
from loggrove.schema import ARRIVAL_SEQ, ENCODED_COLUMNS, FEATURE_COLUMNS, PREFIX_FIXED_COLUMNS
from loggrove.scratch import scratch_path, written
from loggrove.sources.lines import stream_lines
from loggrove.sources.registry import parse
from loggrove.sources.tables import events_log, read_table
from loggrove.streaming import blocks as stream_blocks, jobs, replay

DELIVERIES, FILES = 3, 4  # deliveries follow each other, each of a few files
FILE_LINES = 100_000  # a delivery of raw lines comes in more files than FILES where they would hold more lines
KS = (3, 5, 10)


def vocabulary(spark, folder, block):
    log = events_log(spark, folder, block)
    return written(append_codes(log.select(*[known(F.col(c)).alias(c) for c in ENCODED_COLUMNS])), "vocab")


def event_stream(spark, folder, block):
    """The events as structured rows, delivered in a few files and read as a stream."""
    log = events_log(spark, folder, block)
    rows = log.select(
        ARRIVAL_SEQ, F.date_format("datetime", "yyyy-MM-dd").alias("date"), F.date_format("datetime", "HH:mm:ss").alias("time"),
        F.lit(0).cast("long").alias("pid"), "log_level", "component", "event_type", "block_id", "source_ip", "destination_ip", "block_size",
        F.concat("raw_message", F.lit(" #"), ARRIVAL_SEQ).alias("raw_message"))
    path = scratch_path(spark, "stream-in")
    for part in deliveries(rows):
        part.write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", str(FILES)).parquet(path)
    return drop_invalid(coerce(stream))


def files_of(lines):
    """In how many files a delivery of raw lines comes: each is written by one task."""
    last = lines.agg(F.max(ARRIVAL_SEQ)).first()[0]
    return max(FILES, -(-((last or 0) + 1) // (DELIVERIES * FILE_LINES)))


def deliveries(rows, files=FILES):
    """The rows in DELIVERIES parts of consecutive arrival, each in ``files`` ranges: a file stream takes the oldest files first."""
    last = rows.agg(F.max(ARRIVAL_SEQ)).first()[0]
    for number in range(DELIVERIES):
        part = rows.where(F.floor(F.col(ARRIVAL_SEQ) * DELIVERIES / F.lit((last or 0) + 1)) == number)
        yield part.repartitionByRange(files, ARRIVAL_SEQ).sortWithinPartitions(ARRIVAL_SEQ)


def streamed_lines(spark, folder, rejects=False):
    """All rows that a stream of raw HDFS lines gives. Every tenth line is delivered a second time, a delivery later."""
    lines = written(hdfs_lines(spark, folder, dealt=True), "rendered-lines")
    files = files_of(lines)
    path, checkpoint, out = (scratch_path(spark, x) for x in ("line-stream-in", "line-stream-state", "line-stream-out"))
    before = None
    for part in deliveries(lines, files):
        again = part if before is None else part.unionByName(before)
        before = part.where(F.col(ARRIVAL_SEQ) % 10 == 0)
        again.select("value").write.mode("append").text(path)
    before.select("value").write.mode("append").text(path)
    batch = drop_invalid(coerce(recognized(parse(lines, "hdfs"))))
    values = written(batch.select(*[known(F.col(c)).alias(c) for c in ENCODED_COLUMNS]).distinct(), "values")
    vocab = written(append_codes(values), "vocab")
    events = stream_blocks.encoded_events(stream_lines(spark, path, 2 * files), "hdfs", vocab, rejects)
    stream_blocks.block_stream(events, "hdfs", KS, timeout_seconds=None, vocab=vocab).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream_blocks.OUTPUT_SCHEMA).parquet(out), stream_blocks.open_blocks(spark, checkpoint)


CONTENT = "date, time, pid, log_level, component, event_type, block_id, source_ip, destination_ip, block_size, raw_message"
LINE_LOG = f"""(SELECT min(arrival_seq) AS arrival_seq, CAST(date || ' ' || time AS TIMESTAMP) AS datetime, block_id, log_level, component, event_type,
  source_ip, destination_ip, block_size FROM ({HDFS_SQL}) WHERE date IS NOT NULL GROUP BY {CONTENT})"""


@query(features_sql(LINE_LOG))
def stream_features_of_raw_lines(spark, folder):
    """Raw lines, streamed, parsed and folded by block: the features of each distinct line once."""
    return streamed_lines(spark, folder)[1].select("block_id", *FEATURE_COLUMNS)


@query(f"""SELECT block_id, CAST(count(DISTINCT ({CONTENT})) AS BIGINT) AS accepted,
  CAST(count(*) + count(CASE WHEN arrival_seq % 10 = 0 THEN 1 END) - count(DISTINCT ({CONTENT})) AS BIGINT) AS duplicates
  FROM ({HDFS_SQL}) WHERE date IS NOT NULL GROUP BY block_id""")
def stream_duplicates_by_block(spark, folder):
    """Lines that the stream took and those it had met before, across its batches."""
    counts = streamed_lines(spark, folder)[0].where("kind = 'counts'")
    return counts.groupBy("block_id").agg(F.sum("accepted").cast("long").alias("accepted"), F.sum("duplicates").cast("long").alias("duplicates"))


UNSEEN = ", ".join(f"CAST(0 AS BIGINT) AS unseen_{c}" for c in ENCODED_COLUMNS)


@query(f"""SELECT CAST(count(DISTINCT CASE WHEN date IS NOT NULL THEN ({CONTENT}) END) AS BIGINT) AS accepted,
  CAST(count(CASE WHEN date IS NOT NULL THEN 1 END) + count(CASE WHEN date IS NOT NULL AND arrival_seq % 10 = 0 THEN 1 END)
    - count(DISTINCT CASE WHEN date IS NOT NULL THEN ({CONTENT}) END) AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS late,
  CAST(count(CASE WHEN date IS NULL THEN 1 END) + count(CASE WHEN date IS NULL AND arrival_seq % 10 = 0 THEN 1 END) AS BIGINT) AS rejected,
  {UNSEEN}, CAST(count(*) + count(CASE WHEN arrival_seq % 10 = 0 THEN 1 END) AS BIGINT) AS received FROM ({HDFS_SQL})""")
def stream_line_accounting(spark, folder):
    """What became of each line that was streamed; the vocabulary knows all values here. The counts are rows of the
    stream, so they outlive its driver, and they add up to the lines received."""
    counts = streamed_lines(spark, folder, True)[0].where("kind = 'counts'")
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in jobs.COUNTS])
    return totals.withColumn("received", sum((F.col(c) for c in ("accepted", "duplicates", "late")), F.col("rejected")))


def finished(spark, folder, block, source):
    """All rows of a run: what the stream emitted, then the blocks still in flight."""
    vocab = vocabulary(spark, folder, block)
    events = stream_blocks.code_events(event_stream(spark, folder, block), vocab)
    checkpoint, out = scratch_path(spark, "stream-state"), scratch_path(spark, "stream-out")
    run = stream_blocks.block_stream(events, source, KS).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream_blocks.OUTPUT_SCHEMA).parquet(out).unionByName(stream_blocks.open_blocks(spark, checkpoint))


@query(features_sql(events_sql()))
def stream_features_at_end_of_stream(spark, folder):
    """Blocks that only the end of the stream closes: the same features as in batch."""
    rows = finished(spark, folder, "user", "django")
    return rows.where("kind = 'final' and reason = 'end_of_stream'").select("block_id", *FEATURE_COLUMNS)


@query(features_sql(events_sql("identity_hour")))
def stream_features_with_timeout(spark, folder):
    """Identity-hours closed by silence: the same features as in batch."""
    return finished(spark, folder, "identity_hour", "cloudtrail").where("kind = 'final'").select("block_id", *FEATURE_COLUMNS)


SNAPSHOT_COLUMNS = ", ".join(["block_id", "k", *PREFIX_FIXED_COLUMNS, *[f"count_{t}" for t in EVENT_TYPES]])


@query(f"SELECT {SNAPSHOT_COLUMNS} FROM ({prefix_sql(events_sql(), KS)}) WHERE total_events >= k")
def stream_prefix_snapshots(spark, folder):
    from loggrove.operators.prefix import count_columns

    rows = finished(spark, folder, "user", "django").where("kind = 'snapshot'")
    return count_columns(rows, EVENT_TYPES).select("block_id", "k", *PREFIX_FIXED_COLUMNS, *[f"count_{t}" for t in EVENT_TYPES])


@query("""SELECT to_timestamp(s)::TIMESTAMP AS window_start, count(*) AS events, count(*) / 5 AS events_per_second FROM
  (SELECT unnest(range(CAST(floor(epoch(ts)) AS BIGINT) - 4, CAST(floor(epoch(ts)) AS BIGINT) + 1)) AS s FROM events) GROUP BY s""")
def sliding_event_rate(spark, folder):
    return jobs.events_per_second(read_table(spark, folder, "events"))


def scorer(spark, folder):
    """Models for the user blocks, all fitted by batch jobs."""
    vocab = vocabulary(spark, folder, "user")
    log = events_log(spark, folder)
    features = written(block_features(log, vocab), "features")
    deployed = forests.train(features, ForestParams(contamination=0.1), vocab=vocab)
    labels = user_blocks(spark, folder).select("block_id", F.col("true_label").alias("label"))
    early = train_early_warning(prefix_features(log, KS, vocab), labels, list(EVENT_TYPES), vocab=vocab)
    scored = written(forests.predict(features, deployed), "scored")
    return vocab, jobs.Scorer(deployed, early.forest, early.thresholds, list(EVENT_TYPES), deployed,
                              Policy(0.6, 0.3, 0.1, 0.5, 0.25, 0.2), Normalizer.fit(scored))


def scored_run(spark, folder):
    vocab, models = scorer(spark, folder)
    events = stream_blocks.code_events(event_stream(spark, folder, "user"), vocab)
    out, checkpoint = scratch_path(spark, "run"), scratch_path(spark, "run-state")
    jobs.run_stream(events, "django", models, "run-1", out, checkpoint).awaitTermination()
    jobs.flush(spark, models, "run-1", out, checkpoint)
    return jobs.read_outputs(spark, out)


@query()
def stream_run_status(spark, folder):
    tables = scored_run(spark, folder)
    return jobs.run_status(tables["alerts"], tables["decisions"], tables["counts"])


@query()
def stream_decisions_with_leads(spark, folder):
    tables = scored_run(spark, folder)
    return jobs.with_leads(tables["decisions"], tables["alerts"])


# --- reports on the tables of finished runs, read out of the event table --------
RUN_ALERTS = """(SELECT 'run-' || (user_id % 3) || ':' || t || ':user-' || user_id AS alert_id, 'run-' || (user_id % 3) AS run_id, t AS type, 'user-' || user_id AS block_id,
    min(ts) AS event_time, CAST(CASE WHEN t = 'early_warning' THEN 3 + user_id % 20 END AS INTEGER) AS k
  FROM (SELECT *, CASE event_type WHEN 'error' THEN 'early_warning' ELSE 'block_anomaly' END AS t FROM events WHERE event_type = 'error' AND value > 40 OR event_type = 'purchase' AND value > 120)
  GROUP BY user_id, t)"""
RUN_DECISIONS = f"""(SELECT 'run-' || (CAST(replace(block_id, 'user-', '') AS BIGINT) % 3) AS run_id, block_id, event_frequency AS events, last_seen AS last_event_time, predicted_label,
  CASE WHEN errors % 2 = 0 THEN 'timeout' ELSE 'end_of_stream' END AS reason, CASE WHEN anomaly_score > 0.3 THEN 'HOT' WHEN anomaly_score > 0.28 THEN 'WARM' ELSE 'COLD' END AS tier,
  CASE WHEN anomaly_score > 0.3 THEN event_frequency ELSE 1 END AS lines_kept FROM {USER_BLOCKS})"""


def run_alerts(spark, folder):
    chosen = read_table(spark, folder, "events").where(
        "event_type = 'error' and value > 40 or event_type = 'purchase' and value > 120")
    kind = F.when(F.col("event_type") == "error", "early_warning").otherwise("block_anomaly")
    firsts = chosen.groupBy("user_id", kind.alias("type")).agg(F.min("ts").alias("event_time"))
    return firsts.select(
        F.concat(F.lit("run-"), F.col("user_id") % 3, F.lit(":"), "type", F.lit(":user-"), "user_id").alias("alert_id"),
        F.concat(F.lit("run-"), F.col("user_id") % 3).alias("run_id"), "type", F.concat(F.lit("user-"), "user_id").alias("block_id"), "event_time",
        F.when(F.col("type") == "early_warning", 3 + F.col("user_id") % 20).cast("int").alias("k"))


def run_decisions(spark, folder):
    number = F.regexp_replace("block_id", "user-", "").cast("long")
    return user_blocks(spark, folder).select(
        F.concat(F.lit("run-"), number % 3).alias("run_id"), "block_id", F.col("event_frequency").alias("events"),
        F.col("last_seen").alias("last_event_time"), "predicted_label",
        F.when(F.col("errors") % 2 == 0, "timeout").otherwise("end_of_stream").alias("reason"),
        F.when(F.col("anomaly_score") > 0.3, "HOT").when(F.col("anomaly_score") > 0.28, "WARM").otherwise("COLD").alias("tier"),
        F.when(F.col("anomaly_score") > 0.3, F.col("event_frequency")).otherwise(F.lit(1)).alias("lines_kept"), "true_label")


@query(f"""SELECT a.*, d.events AS events_total, d.reason AS block_finalized, (d.events - a.k) / d.events AS lead_fraction FROM {RUN_ALERTS} a
LEFT JOIN {RUN_DECISIONS} d USING (run_id, block_id) WHERE a.type = 'early_warning'""")
def leads_written_on_alerts(spark, folder):
    return jobs.alerts_with_leads(run_alerts(spark, folder), run_decisions(spark, folder))


@query(f"""SELECT d.run_id, count(*) AS blocks_decided, CAST(sum(events) AS BIGINT) AS lines_seen, CAST(sum(lines_kept) AS BIGINT) AS lines_kept,
  count(*) FILTER (tier = 'HOT') AS hot_blocks, count(*) FILTER (tier = 'WARM') AS warm_blocks, count(*) FILTER (tier = 'COLD') AS cold_blocks,
  count(*) FILTER (reason = 'timeout') AS timeout_blocks, count(*) FILTER (reason = 'end_of_stream') AS end_of_stream_blocks,
  (SELECT count(*) FROM {RUN_ALERTS} a WHERE a.run_id = d.run_id AND type = 'early_warning') AS early_warning_alerts,
  (SELECT count(*) FROM {RUN_ALERTS} a WHERE a.run_id = d.run_id AND type = 'block_anomaly') AS block_anomaly_alerts,
  100.0 * (1 - CAST(sum(lines_kept) AS DOUBLE) / sum(events)) AS storage_saved_pct FROM {RUN_DECISIONS} d GROUP BY d.run_id""")
def run_status(spark, folder):
    return jobs.run_status(run_alerts(spark, folder), run_decisions(spark, folder))


@query(f"""SELECT * FROM {RUN_ALERTS} WHERE type = 'early_warning' AND run_id = (SELECT arg_max(run_id, event_time) FROM {RUN_ALERTS}) ORDER BY event_time DESC, alert_id LIMIT 20""")
def newest_run_alerts(spark, folder):
    return jobs.list_alerts(run_alerts(spark, folder), "early_warning", 20)


HALF = "(SELECT count(*) // 2 FROM events)"
COVERAGE = f"""(SELECT 'user-' || user_id AS block_id, count(*) FILTER (event_id < {HALF}) AS lines_in_replay, count(*) AS lines_in_file,
  count(*) FILTER (event_id < {HALF}) >= count(*) - 25 AS complete FROM events GROUP BY ALL)"""
JUDGED = f"""(SELECT d.*, b.true_label AS label, a.event_time AS alert_time, a.block_id IS NOT NULL AS early_alert, c.lines_in_replay, c.lines_in_file, c.complete, b.true_label IS NULL AS unlabeled,
  coalesce(b.true_label, 'Normal') = 'Anomaly' AS is_anomaly, d.predicted_label = 'Anomaly' AS block_alert,
  CAST(floor(epoch(d.last_event_time)) - floor(epoch(a.event_time)) AS BIGINT) AS lead_seconds, (d.events - a.k) / d.events AS early_warning_lead
  FROM {RUN_DECISIONS} d LEFT JOIN (SELECT block_id, true_label FROM {USER_BLOCKS} WHERE errors % 5 <> 0) b USING (block_id)
  LEFT JOIN (SELECT * FROM {RUN_ALERTS} WHERE type = 'early_warning') a USING (block_id) LEFT JOIN {COVERAGE} c USING (block_id))"""


def judged(spark, folder):
    decisions = run_decisions(spark, folder)
    labels = user_blocks(spark, folder).where(F.col("errors") % 5 != 0).select("block_id", F.col("true_label").alias("label"))
    alerts = run_alerts(spark, folder)
    events = read_table(spark, folder, "events")
    half = events.count() // 2
    log = events.select(F.concat(F.lit("user-"), "user_id").alias("block_id"), F.col("event_id").alias(ARRIVAL_SEQ))
    coverage = replay.replay_coverage(log, half).withColumn("complete", F.col("lines_in_replay") >= F.col("lines_in_file") - 25)
    early = alerts.where("type = 'early_warning'")
    rows = replay.judged_decisions(decisions.drop("true_label"), labels, early, coverage)
    return jobs.with_leads(rows, early).drop("early_warning_k")


@query(f"SELECT * FROM {JUDGED}")
def decisions_joined_with_labels_and_alerts(spark, folder):
    return judged(spark, folder)


def detection_sql(source: str, flag: str, name: str, where: str = "TRUE") -> str:
    return f"""SELECT '{name}' AS measure, complete, count(*) AS blocks, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER ({flag}) AS alerts,
      count(*) FILTER ({flag} AND is_anomaly) AS true_alerts, count(*) FILTER ({flag} AND NOT is_anomaly) AS false_alerts FROM {source} WHERE {where} GROUP BY complete"""


@query(f"""SELECT *, {ratio('true_alerts', 'alerts', 'NULL')} AS "precision", {ratio('true_alerts', 'anomalies', 'NULL')} AS recall,
  {ratio('false_alerts', 'blocks - anomalies', 'NULL')} AS false_alarm_rate, {ratio('anomalies', 'blocks', 'NULL')} AS anomaly_share FROM (WITH j AS {JUDGED}
  {detection_sql('j', 'block_alert', 'block_anomaly')} UNION ALL {detection_sql('j', 'early_alert', 'early_warning')}
  UNION ALL {detection_sql('j', 'early_alert', 'early_warning_reaching_k', 'events >= 70')})""")
def replay_detection_report(spark, folder):
    return replay.replay_report(written(judged(spark, folder), "judged"), ["complete"], 70)


@query(f"""SELECT reason, count(early_warning_lead) AS n, avg(early_warning_lead) AS mean_lead, avg(lead_seconds) AS mean_lead_seconds,
  count(*) FILTER (early_warning_lead > 0) AS before_block_end, median(early_warning_lead) AS median_lead, median(lead_seconds) AS median_lead_seconds
FROM {JUDGED} WHERE early_alert AND is_anomaly GROUP BY reason""")
def replay_lead_report(spark, folder):
    return replay.lead_report(written(judged(spark, folder), "judged"), ["reason"])
