"""Line formats, envelopes, windows and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loggrove.functions.templates import normalize_template
from loggrove.queries import rendered
from loggrove.queries.registry import query
from loggrove.queries.sqltext import EVENTS_K
from loggrove.scratch import scratch_path
from loggrove.sources import apache, cloudtrail, hdfs
from loggrove.sources.lines import first_lines, read_lines, syslog_message
from loggrove.sources.registry import parse, read_source, union_sources
from loggrove.sources.tables import read_table


@query(rendered.HDFS_SQL)
def hdfs_lines_to_columns(spark, folder):
    return parse(rendered.hdfs_lines(spark, folder), "hdfs")


@query(rendered.OPENSTACK_SQL.replace("{request}", "FALSE"))
def openstack_lines_to_columns(spark, folder):
    return parse(rendered.openstack_lines(spark, folder), "openstack")


@query(rendered.OPENSTACK_SQL.replace("{request}", "TRUE"))
def openstack_lines_with_request_fallback(spark, folder):
    return parse(rendered.openstack_lines(spark, folder), "openstack", fallback_to_request_id=True)


@query(rendered.APACHE_SQL)
def apache_lines_to_columns(spark, folder):
    return parse(rendered.apache_lines(spark, folder), "apache")


@query(rendered.DJANGO_SQL)
def django_lines_to_columns(spark, folder):
    return parse(rendered.django_lines(spark, folder), "django")


@query(rendered.AUDIT_SQL)
def audit_records_to_columns(spark, folder):
    records = rendered.audit_records(spark, folder).withColumn(
        "record", F.from_json("value", cloudtrail.RECORD_SCHEMA)).drop("value")
    return parse(records, "cloudtrail")


@query(rendered.AUDIT_SQL.replace("event_id AS arrival_seq, ", ""))
def audit_files_to_columns(spark, folder):
    """The records written as ``{"Records": […]}`` documents, one per user and hour, read back."""
    path = scratch_path(spark, "audit")
    records = rendered.events(spark, folder).select("arrival_seq", "user_id", F.date_trunc("HOUR", "ts").alias("hour"))
    typed = rendered.audit_records(spark, folder).join(records, "arrival_seq")
    # A delivery holds one user's hour, as real deliveries hold a few minutes of one account.
    documents = typed.groupBy("user_id", "hour").agg(
        F.concat(F.lit('{"Records":['), F.concat_ws(",", F.collect_list("value")), F.lit("]}")).alias("value"))
    documents.select("value").write.option("compression", "gzip").text(path)
    return parse(cloudtrail.read_records(spark, path).select("record"), "cloudtrail")


@query("""SELECT event_type, block_id, source_ip, count(*) AS lines FROM (""" + rendered.HDFS_SQL + """) GROUP BY ALL""")
def hdfs_files_scan(spark, folder):
    """The lines written as text files and scanned back with their arrival order."""
    path = scratch_path(spark, "lines")
    rendered.hdfs_lines(spark, folder).select("value").write.text(path)
    rows = read_source(spark, "hdfs", path)
    return rows.groupBy("event_type", "block_id", "source_ip").agg(F.count("*").alias("lines"))


@query(f"""SELECT [ 'Receiving block', 'Received block', 'PacketResponder', 'BLOCK* NameSystem.allocateBlock', 'BLOCK* NameSystem.addStoredBlock',
  'Served block', 'Starting thread', 'Transmitted block', 'BLOCK* ask', 'Verification'][k % 10 + 1] AS wording,
  ['RECEIVE_BLOCK','RECEIVED_BLOCK','PACKET_TERMINATED','ALLOCATE_BLOCK','STORE_BLOCK','SERVE_BLOCK','START_TRANSFER',
   'TRANSMIT_BLOCK','REPLICATE_BLOCK','OTHER'][k % 10 + 1] AS event_type, count(*) AS lines
FROM {EVENTS_K} WHERE k <> 99 GROUP BY ALL""")
def hdfs_event_taxonomy(spark, folder):
    lines = rendered.hdfs_lines(spark, folder).where(~F.col("value").startswith("java."))
    message = F.regexp_extract("value", hdfs.LINE, 6)
    words = ("Receiving block", "Received block", "PacketResponder", "BLOCK* NameSystem.allocateBlock",
             "BLOCK* NameSystem.addStoredBlock", "Served block", "Starting thread", "Transmitted block", "BLOCK* ask", "Verification")
    wording = F.coalesce(*[F.when(message.contains(w), F.lit(w)) for w in words])
    return lines.groupBy(wording.alias("wording"), hdfs.classify(message).alias("event_type")).agg(F.count("*").alias("lines"))


@query("""SELECT 'win-' || strftime(time_bucket(INTERVAL '300 seconds', ts), '%Y%m%dT%H%M%S') AS block_id, count(*) AS lines
FROM events GROUP BY ALL""")
def fixed_time_windows(spark, folder):
    events = read_table(spark, folder, "events")
    return events.groupBy(apache.window_block_id(F.col("ts"), 300).alias("block_id")).agg(F.count("*").alias("lines"))


@query(f"""SELECT event_id, CASE WHEN k % 3 IN (0, 1) AND event_type <> 'view' THEN event_type || ' k=' || k END AS message FROM {EVENTS_K}""")
def syslog_envelopes(spark, folder):
    rows = rendered.events(spark, folder)
    body = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.concat("event_type", F.lit(" k="), "k"))
    line = F.when(F.col("k") % 3 == 0, F.concat(F.lit("<134>1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                                                F.lit(' host app 12 ID47 [ex@1 a="b"][two c="d"] ﻿'), body)) \
        .when(F.col("k") % 3 == 1, F.concat(F.lit("<34>"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host su[9]: "), body, F.lit("\r\n"))) \
        .otherwise(body)
    return rows.select(F.col("arrival_seq").alias("event_id"), syslog_message(line).alias("message"))


def template_sql(text: str) -> str:
    """The template of a text. The look-behind of the path pattern is a captured blank here, and the
    look-ahead after a number's end can never fail, so it is left out."""
    out = f"coalesce({text}, '')"
    for pattern, placeholder in (
        (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
        (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<ip>"),
        (r"(^|\s)(?:[a-zA-Z]+://)?[\w.\p{L}\p{N}-]*(?:/[^\s\"'',;)\]]*)+", r"\1<path>"),
        (r"\b(?:0x)?[0-9a-fA-F]*\d[0-9a-fA-F]*\b", "<n>"),
        (r"\s+", " "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{placeholder}', 'g')"
    return f"coalesce(nullif(substr(trim({out}), 1, 120), ''), '<empty>')"


@query(f"SELECT {template_sql('url')} AS template, count(*) AS pages FROM pages GROUP BY 1")
def url_templates(spark, folder):
    """How many pages share an address template."""
    pages = read_table(spark, folder, "pages")
    return pages.groupBy(normalize_template(F.col("url")).alias("template")).agg(F.count("*").alias("pages"))


@query(f"SELECT role, {template_sql('text')} AS template, count(*) AS turns FROM conversations GROUP BY 1, 2")
def message_templates(spark, folder):
    """Templates of the whole message text of every conversation turn."""
    turns = read_table(spark, folder, "conversations")
    return turns.groupBy("role", normalize_template(F.col("text")).alias("template")).agg(F.count("*").alias("turns"))


@query("""SELECT event_id AS arrival_seq, event_type FROM events ORDER BY event_id LIMIT 500""")
def first_lines_in_arrival_order(spark, folder):
    rows = rendered.events(spark, folder)
    return first_lines(rows, 500).select("arrival_seq", "event_type")


@query("""SELECT source, count(*) AS lines, CAST(count(block_id) AS BIGINT) AS with_block, count(DISTINCT event_type) AS event_types FROM (
  SELECT 'hdfs' AS source, block_id, event_type FROM (""" + rendered.HDFS_SQL + """)
  UNION ALL SELECT 'openstack', block_id, event_type FROM (""" + rendered.OPENSTACK_SQL.replace("{request}", "FALSE") + """)
  UNION ALL SELECT 'apache', block_id, event_type FROM (""" + rendered.APACHE_SQL + """)
  UNION ALL SELECT 'django', block_id, event_type FROM (""" + rendered.DJANGO_SQL + """)) GROUP BY ALL""")
def sources_united(spark, folder):
    makers = {"hdfs": rendered.hdfs_lines, "openstack": rendered.openstack_lines,
              "apache": rendered.apache_lines, "django": rendered.django_lines}
    frames = [parse(make(spark, folder).withColumn("source", F.lit(name)), name) for name, make in makers.items()]
    per_type = union_sources(frames).groupBy("source", "event_type").agg(F.count("*").alias("n"), F.count("block_id").alias("b"))
    return per_type.groupBy("source").agg(F.sum("n").alias("lines"), F.sum("b").alias("with_block"), F.count("*").alias("event_types"))


@query("SELECT count(*) AS lines, CAST(0 AS BIGINT) AS inversions FROM events")
def lines_in_file_order(spark, folder):
    """Arrival order survives a write and a scan: inversions of the event number inside the files."""
    path = scratch_path(spark, "ordered")
    rendered.events(spark, folder).orderBy("arrival_seq").select(F.col("arrival_seq").cast("string").alias("value")).write.text(path)
    from pyspark.sql import Window

    order = Window.partitionBy("arrival_chunk").orderBy("arrival_seq")
    rows = read_lines(spark, path).withColumn("number", F.col("value").cast("long"))
    return rows.withColumn("before", F.lag("number").over(order)).agg(
        F.count("*").alias("lines"), F.count_if(F.col("before") > F.col("number")).alias("inversions"))


@query("""SELECT source, event_type, count(*) AS lines FROM (SELECT 'hdfs' AS source, event_type FROM (""" + rendered.HDFS_SQL + """)
  UNION ALL SELECT 'django', event_type FROM (""" + rendered.DJANGO_SQL + """)) WHERE source = 'django' GROUP BY ALL""")
def stored_tables_by_source(spark, folder):
    """Structured rows stored per source, one source read back."""
    from loggrove.sources import sinks

    root = scratch_path(spark, "store")
    for name, make in (("hdfs", rendered.hdfs_lines), ("django", rendered.django_lines)):
        sinks.write_table(parse(make(spark, folder), name), root, "structured", name)
    return sinks.read_table(spark, root, "structured", "django").groupBy("source", "event_type").agg(F.count("*").alias("lines"))


@query("""SELECT 'user-' || user_id AS key, count(*) AS messages FROM events GROUP BY ALL""")
def messages_keyed_by_block(spark, folder):
    from loggrove.sources import sinks
    from loggrove.sources.tables import events_log

    return sinks.messages(events_log(spark, folder)).where(F.get_json_object("value", "$.raw_message").isNotNull()).groupBy("key").agg(
        F.count("*").alias("messages"))
