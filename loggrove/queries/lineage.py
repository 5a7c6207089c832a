"""Version history operators on a history read out of the event table.

Every user stands for one log source: a purchase is a promotion, a signup a rollback to
the day before, any other event a rejected candidate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loggrove.plans import lineage
from loggrove.queries.registry import query
from loggrove.sources.tables import read_table

HISTORY = """(SELECT 'user-' || user_id AS source, ts AS "at", CASE event_type WHEN 'signup' THEN 'rollback' ELSE 'decision' END AS event,
  event_type = 'purchase' AS promoted, CAST(CASE event_type WHEN 'signup' THEN dayofyear(ts) + 1 END AS INTEGER) AS from_version,
  CAST(CASE event_type WHEN 'signup' THEN dayofyear(ts) END AS INTEGER) AS to_version,
  CAST(CASE event_type WHEN 'purchase' THEN dayofyear(ts) + 1 END AS INTEGER) AS new_version, value AS candidate_value
  FROM events)"""


def history(spark, folder):
    kind, day = F.col("event_type"), F.dayofyear("ts")
    return read_table(spark, folder, "events").select(
        F.concat(F.lit("user-"), "user_id").alias("source"), F.col("ts").alias("at"),
        F.when(kind == "signup", "rollback").otherwise("decision").alias("event"), (kind == "purchase").alias("promoted"),
        F.when(kind == "signup", day + 1).alias("from_version"), F.when(kind == "signup", day).alias("to_version"),
        F.when(kind == "purchase", day + 1).alias("new_version"), F.col("value").alias("candidate_value"))


LIVE = f"""(SELECT source, coalesce(arg_max(t, "at") FILTER (t IS NOT NULL), 1) AS version FROM (
  SELECT source, "at", CASE WHEN promoted THEN new_version WHEN event IN ('rollback', 'manual_promotion') THEN to_version END AS t FROM {HISTORY}) GROUP BY source)"""


@query(f"SELECT * FROM {LIVE}")
def live_model_version(spark, folder):
    return lineage.live_version(history(spark, folder), ["source"])


@query(f"SELECT source, CAST(greatest(coalesce(max(new_version), 1), 1) + 1 AS INTEGER) AS next_version FROM {HISTORY} GROUP BY source")
def next_model_version(spark, folder):
    return lineage.next_version(history(spark, folder), ["source"])


@query(f"""WITH h AS {HISTORY}, issued AS (SELECT source, new_version AS version, max("at") AS promoted_at, arg_max(candidate_value, "at") AS metric_value
    FROM h WHERE new_version IS NOT NULL GROUP BY source, new_version),
  every AS (SELECT source, version, promoted_at, metric_value FROM issued UNION ALL
    SELECT DISTINCT source, CAST(1 AS INTEGER), CAST(NULL AS TIMESTAMP), CAST(NULL AS DOUBLE) FROM h WHERE source NOT IN (SELECT source FROM issued WHERE version = 1))
SELECT e.*, CASE WHEN e.version = l.version THEN 'active' WHEN r.version IS NOT NULL AND e.version > l.version THEN 'rolled_back' ELSE 'retired' END AS status
FROM every e JOIN {LIVE} l USING (source) LEFT JOIN (SELECT DISTINCT source, from_version AS version FROM h WHERE event = 'rollback') r
  ON r.source = e.source AND r.version = e.version""")
def model_version_table(spark, folder):
    return lineage.version_table(history(spark, folder), ["source"])


# The issued version of the best value is put back into service by hand, a day after the last event.
BEST = f"""(SELECT source, new_version AS to_version FROM (SELECT source, new_version,
  row_number() OVER (PARTITION BY source ORDER BY candidate_value DESC NULLS LAST, new_version) AS n FROM {HISTORY} WHERE new_version IS NOT NULL) WHERE n = 1)"""
LAST = f"""(SELECT source, max("at") AS last_at FROM {HISTORY} GROUP BY source)"""


def recorded(spark, folder):
    past = history(spark, folder)
    best = past.groupBy("source").agg(
        F.max_by("new_version", F.when(F.col("new_version").isNotNull(), F.struct("candidate_value", -F.col("new_version")))).alias("to_version"),
        (F.max("at") + F.expr("INTERVAL 1 DAY")).alias("at"))
    asked = best.withColumns({"event": F.lit("manual_promotion"), "reason": F.lit("best value of all versions")})
    return past, lineage.overrides(past, asked, ["source"])


@query(f"""SELECT b.source, t.last_at + INTERVAL 1 DAY AS "at", 'manual_promotion' AS event, l.version AS from_version, b.to_version, 'best value of all versions' AS reason
FROM {BEST} b JOIN {LIVE} l USING (source) JOIN {LAST} t USING (source)""")
def recorded_overrides(spark, folder):
    return recorded(spark, folder)[1].select("source", "at", "event", "from_version", "to_version", "reason")


@query(f"SELECT l.source, coalesce(b.to_version, l.version) AS version FROM {LIVE} l LEFT JOIN {BEST} b USING (source)")
def live_version_after_overrides(spark, folder):
    past, events = recorded(spark, folder)
    return lineage.live_version(past.unionByName(events.drop("reason")), ["source"])


# A candidate is compared with the mean of the source's earlier values as the live metric.
MEANS = "(SELECT 'user-' || user_id AS source, avg(value) / 500 AS live_f1, max(value) / 500 AS best_f1, count(*) AS n FROM events GROUP BY ALL)"


def means(spark, folder):
    return read_table(spark, folder, "events").groupBy(F.concat(F.lit("user-"), "user_id").alias("source")).agg(
        (F.avg("value") / 500).alias("live_f1"), (F.max("value") / 500).alias("best_f1"), F.count("*").alias("n"))


@query(f"""SELECT m.source, best_f1 > live_f1 AS promoted, CASE WHEN best_f1 > live_f1 THEN CAST(v.next_version AS INTEGER) END AS new_version FROM {MEANS} m
JOIN (SELECT source, greatest(coalesce(max(new_version), 1), 1) + 1 AS next_version FROM {HISTORY} GROUP BY source) v USING (source)""")
def promotion_decisions(spark, folder):
    better = F.col("best_f1") > F.col("live_f1")
    return means(spark, folder).join(lineage.next_version(history(spark, folder), ["source"]), "source").select(
        "source", better.alias("promoted"), F.when(better, F.col("next_version")).alias("new_version"))


@query(f"""SELECT source, CASE WHEN n <= 60 THEN 'unavailable' WHEN n <= 62 THEN 'unverified' WHEN live_f1 < 0.4 THEN 'degraded' ELSE 'healthy' END AS health FROM
  (SELECT source, n, avg(x) AS live_f1 FROM (SELECT 'user-' || user_id AS source, count(*) OVER (PARTITION BY user_id) AS n, least(1.0, value / 100) AS x FROM events) GROUP BY ALL)""")
def model_health(spark, folder):
    rows = read_table(spark, folder, "events").groupBy(F.concat(F.lit("user-"), "user_id").alias("source")).agg(
        F.count("*").alias("n"), F.avg(F.least(F.lit(1.0), F.col("value") / 100)).alias("f1"))
    f1 = F.when(F.col("n") > 62, F.col("f1"))
    return rows.select("source", lineage.health(F.col("n") > 60, f1).alias("health"))


@query(f"""SELECT l.source, l.version, p.policy_version, p.policy_version IS NOT NULL AND p.policy_version <> l.version AS stale FROM {LIVE} l
JOIN (SELECT 'user-' || user_id AS source, CAST(max(dayofyear(ts) + 1) FILTER (event_type = 'purchase') AS INTEGER) AS policy_version FROM events GROUP BY ALL) p USING (source)""")
def stale_policies(spark, folder):
    policies = read_table(spark, folder, "events").groupBy(F.concat(F.lit("user-"), "user_id").alias("source")).agg(
        F.max(F.when(F.col("event_type") == "purchase", F.dayofyear("ts") + 1)).alias("policy_version"))
    return lineage.live_version(history(spark, folder), ["source"]).join(policies, "source").select(
        "source", "version", "policy_version", lineage.is_stale(F.col("policy_version"), F.col("version")).alias("stale"))
