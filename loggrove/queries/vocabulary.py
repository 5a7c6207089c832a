"""Dictionary operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loggrove.operators import vocab
from loggrove.operators.clean import known
from loggrove.queries.registry import query
from loggrove.queries.sqltext import ORDER_LOG, events_log as events_sql, known as known_sql
from loggrove.schema import ENCODED_COLUMNS
from loggrove.sources.tables import events_log, order_log

VALUES = "UNION ALL ".join(f"SELECT DISTINCT '{c}' AS \"column\", {known_sql(c)} AS value FROM {{log}} " for c in ENCODED_COLUMNS)


def vocab_sql(log: str) -> str:
    return f"""(SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INTEGER) AS code
      FROM ({VALUES.replace('{log}', log)}))"""


EVENTS_VOCAB = vocab_sql(events_sql())
# Codes first given to the order log, then the event log's new values appended.
GROWN_VOCAB = f"""(WITH old AS {vocab_sql(ORDER_LOG)}, fresh AS (SELECT "column", value FROM {EVENTS_VOCAB} EXCEPT SELECT "column", value FROM old)
  SELECT * FROM old UNION ALL SELECT f."column", f.value, CAST(coalesce(m.top, -1)
    + row_number() OVER (PARTITION BY f."column" ORDER BY f.value) AS INTEGER) AS code
  FROM fresh f LEFT JOIN (SELECT "column", max(code) AS top FROM old GROUP BY ALL) m USING ("column"))"""


def category_frame(log):
    return log.select(*[known(F.col(c)).alias(c) for c in ENCODED_COLUMNS])


def events_vocab(spark, folder):
    return vocab.append_codes(category_frame(events_log(spark, folder)))


def grown_vocab(spark, folder):
    return vocab.append_codes(category_frame(events_log(spark, folder)), vocab.append_codes(category_frame(order_log(spark, folder))))


@query(f"SELECT * FROM {EVENTS_VOCAB}")
def category_codes(spark, folder):
    return events_vocab(spark, folder)


@query(f"SELECT * FROM {GROWN_VOCAB}")
def category_codes_appended(spark, folder):
    return grown_vocab(spark, folder)


@query(f"""SELECT e.arrival_seq, e.block_id, coalesce(v.code, -1) AS source_ip_encoded FROM {events_sql()} e
LEFT JOIN (SELECT * FROM {vocab_sql(ORDER_LOG)} WHERE "column" = 'source_ip') v ON v.value = e.source_ip""")
def codes_read_only(spark, folder):
    """Event rows coded with a vocabulary they must not extend."""
    old = vocab.append_codes(category_frame(order_log(spark, folder)))
    rows = events_log(spark, folder).select("arrival_seq", "block_id", "source_ip")
    return vocab.encode(rows, old, "source_ip").select("arrival_seq", "block_id", "source_ip_encoded")


@query(f"""SELECT "column", count(*) AS unseen FROM (SELECT "column", value FROM {EVENTS_VOCAB} EXCEPT
SELECT "column", value FROM {vocab_sql(ORDER_LOG)}) GROUP BY ALL""")
def unseen_categories(spark, folder):
    old = vocab.append_codes(category_frame(order_log(spark, folder)))
    return vocab.unseen_values(category_frame(events_log(spark, folder)), old).groupBy("column").agg(F.count("*").alias("unseen"))


FINGERPRINT = """SELECT substr(sha256(string_agg(line, '|' ORDER BY line)), 1, 16) AS fingerprint FROM (
  SELECT "column" || ':' || count(*) || ':' || sum(CAST(CAST('0x' || substr(md5("column" || chr(31) || value || chr(31) || code), 1, 15) AS BIGINT) AS DECIMAL(38,0))) AS line
  FROM {vocab} GROUP BY "column")"""


@query(FINGERPRINT.replace("{vocab}", EVENTS_VOCAB))
def vocabulary_fingerprint(spark, folder):
    return vocab.fingerprint(events_vocab(spark, folder))


@query(f"""SELECT o."column", o.value, o.code AS trained_code, e.code AS current_code FROM {vocab_sql(ORDER_LOG)} o
JOIN {EVENTS_VOCAB} e ON o."column" = e."column" AND o.value = e.value WHERE o.code <> e.code""")
def renumbered_categories(spark, folder):
    """The order log's own codes against the event log's: UNKNOWN moves."""
    return vocab.conflicts(vocab.append_codes(category_frame(order_log(spark, folder))), events_vocab(spark, folder))


@query(f"""SELECT "column", count(*) AS n_values FROM {GROWN_VOCAB} GROUP BY ALL""")
def vocabulary_sizes(spark, folder):
    return vocab.sizes(grown_vocab(spark, folder))
