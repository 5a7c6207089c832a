"""Raw lines written from the ``events`` table, one per event, in every log format.

Each line's wording is chosen by fields of the event, so the parsed columns can be
stated as plain SQL over the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loggrove.schema import ARRIVAL_SEQ
from loggrove.sources.tables import read_table


def events(spark: SparkSession, folder: str, dealt: bool = False) -> DataFrame:
    """The fields that lines are worded by; ``dealt`` over all tasks first, as one task reads a whole row group."""
    kind, rows = F.col("event_type"), read_table(spark, folder, "events")
    return (rows.repartition("event_id") if dealt else rows).select(
        F.col("event_id").alias(ARRIVAL_SEQ), "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO").alias("level"),
    ).withColumns({
        "src": F.concat(F.lit("10.0."), F.col("user_id") % 7, F.lit("."), F.col("k") % 20),
        "dst": F.concat(F.lit("10.1.0."), F.col("k") % 10),
        "size": F.floor("value").cast("bigint"),
    })


def _lines(frame: DataFrame, value: Column) -> DataFrame:
    return frame.select(ARRIVAL_SEQ, value.alias("value"))


def hdfs_lines(spark: SparkSession, folder: str, dealt: bool = False) -> DataFrame:
    block = F.concat(F.lit("blk_"), F.when(F.col("k") % 2 == 1, "-").otherwise(""), F.col("user_id"))
    wording = [
        F.concat(F.lit("Receiving block "), block, F.lit(" src: /"), "src", F.lit(":50010 dest: /"), "dst", F.lit(":50010")),
        F.concat(F.lit("Received block "), block, F.lit(" of size "), "size", F.lit(" from /"), "src"),
        F.concat(F.lit("PacketResponder 1 for block "), block, F.lit(" terminating")),
        F.concat(F.lit("BLOCK* NameSystem.allocateBlock: /user/root/part-1. "), block),
        F.concat(F.lit("BLOCK* NameSystem.addStoredBlock: blockMap updated: "), "src", F.lit(":50010 is added to "), block,
                 F.lit(" size "), "size"),
        F.concat("src", F.lit(":50010 Served block "), block, F.lit(" to /"), "dst"),
        F.concat("src", F.lit(":50010:Starting thread to transfer block "), block, F.lit(" to "), "dst", F.lit(":50010")),
        F.concat("src", F.lit(":50010:Transmitted block "), block, F.lit(" to /"), "dst", F.lit(":50010")),
        F.concat(F.lit("BLOCK* ask "), "src", F.lit(":50010 to replicate "), block, F.lit(" to datanode(s) "), "dst", F.lit(":50010")),
        F.concat(F.lit("Verification succeeded for "), block),
    ]
    message = F.element_at(F.array(*wording), F.col("k") % 10 + 1)
    header = F.concat(F.date_format("ts", "yyMMdd HHmmss"), F.lit(" "), F.col("user_id") % 500, F.lit(" "), "level",
                      F.lit(" dfs.Node$"), F.col("k") % 5, F.lit(": "))
    return _lines(events(spark, folder, dealt), F.when(F.col("k") == 99, F.concat(F.lit("java.io.IOException: lost "), block))
                  .otherwise(F.concat(header, message)))


HDFS_SQL = """SELECT event_id AS arrival_seq,
  CASE WHEN k <> 99 THEN strftime(ts, '%Y-%m-%d') END AS date, CASE WHEN k <> 99 THEN strftime(ts, '%H:%M:%S') END AS time,
  CASE WHEN k <> 99 THEN user_id % 500 END AS pid,
  CASE WHEN k <> 99 THEN CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END END AS log_level,
  CASE WHEN k <> 99 THEN 'dfs.Node$' || (k % 5) END AS component,
  CASE WHEN k = 99 THEN 'OTHER' ELSE ['RECEIVE_BLOCK','RECEIVED_BLOCK','PACKET_TERMINATED','ALLOCATE_BLOCK','STORE_BLOCK',
    'SERVE_BLOCK','START_TRANSFER','TRANSMIT_BLOCK','REPLICATE_BLOCK','OTHER'][k % 10 + 1] END AS event_type,
  blk AS block_id,
  CASE WHEN k % 10 IN (0, 1, 4, 5, 6, 7, 8) THEN src END AS source_ip,
  CASE WHEN k % 10 IN (0, 5, 6, 7, 8) THEN dst END AS destination_ip,
  CASE WHEN k % 10 IN (1, 4) THEN size END AS block_size,
  CASE WHEN k = 99 THEN 'java.io.IOException: lost ' || blk ELSE [
    'Receiving block ' || blk || ' src: /' || src || ':50010 dest: /' || dst || ':50010',
    'Received block ' || blk || ' of size ' || size || ' from /' || src,
    'PacketResponder 1 for block ' || blk || ' terminating',
    'BLOCK* NameSystem.allocateBlock: /user/root/part-1. ' || blk,
    'BLOCK* NameSystem.addStoredBlock: blockMap updated: ' || src || ':50010 is added to ' || blk || ' size ' || size,
    src || ':50010 Served block ' || blk || ' to /' || dst,
    src || ':50010:Starting thread to transfer block ' || blk || ' to ' || dst || ':50010',
    src || ':50010:Transmitted block ' || blk || ' to /' || dst || ':50010',
    'BLOCK* ask ' || src || ':50010 to replicate ' || blk || ' to datanode(s) ' || dst || ':50010',
    'Verification succeeded for ' || blk][k % 10 + 1] END AS raw_message
FROM (SELECT *, 'blk_' || CASE WHEN k % 2 = 1 THEN '-' ELSE '' END || user_id AS blk,
        '10.0.' || (user_id % 7) || '.' || (k % 20) AS src, '10.1.0.' || (k % 10) AS dst, CAST(floor(value) AS BIGINT) AS size
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def openstack_lines(spark: SparkSession, folder: str) -> DataFrame:
    hexed = F.lpad(F.hex("user_id"), 12, "0")
    uuid = F.concat(F.lit("b9000564-fe1a-409b-b8cc-"), F.lower(hexed))
    wording = [
        F.concat(F.lit("[instance: "), uuid, F.lit("] VM Started (Lifecycle Event)")),
        F.concat("src", F.lit(' "GET /v2/54fadb412c4e40cdbaed9335e4c35a9e/servers/detail HTTP/1.1" status: 200 len: '), "size",
                 F.lit(" time: 0.24")),
        F.concat(F.lit("[instance: "), uuid, F.lit("] Took "), "size", F.lit(" seconds to spawn the instance on the hypervisor.")),
        F.concat(F.lit("Unknown base file: /var/lib/nova/instances/_base/"), "k"),
    ]
    message = F.element_at(F.array(*wording), F.col("k") % 4 + 1)
    line = F.concat(
        F.lit("nova-compute.log.1.2017-05-16_13:55:31 "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "),
        F.col("user_id") + 1000, F.lit(" "), "level", F.lit(" nova.svc"), F.col("k") % 5,
        F.lit(" [req-38101a0b-2096-447d-96ea-"), F.lower(hexed), F.lit(" 113d3a99c3da401fbd62cc2caa5b96d2 - - -] "), message)
    return _lines(events(spark, folder), F.when(F.col("k") == 98, F.lit("Traceback (most recent call last):")).otherwise(line))


OPENSTACK_SQL = """SELECT event_id AS arrival_seq,
  CASE WHEN ok THEN strftime(ts, '%Y-%m-%d') END AS date, CASE WHEN ok THEN strftime(ts, '%H:%M:%S') END AS time,
  CASE WHEN ok THEN user_id + 1000 END AS pid,
  CASE WHEN ok THEN CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END END AS log_level,
  CASE WHEN ok THEN 'nova.svc' || (k % 5) END AS component,
  CASE WHEN NOT ok THEN 'OTHER' ELSE ['VM Started (Lifecycle Event)', '<ip> "GET <path> <path>" status: <n> len: <n> time: <n>.<n>',
    'Took <n> seconds to spawn the instance on the hypervisor.', 'Unknown base file: <path>'][k % 4 + 1] END AS event_type,
  CASE WHEN ok THEN CASE WHEN k % 4 IN (0, 2) THEN 'b9000564-fe1a-409b-b8cc-' || lpad(lower(to_hex(user_id)), 12, '0')
    WHEN with_request THEN 'req-38101a0b-2096-447d-96ea-' || lpad(lower(to_hex(user_id)), 12, '0') END END AS block_id,
  CASE WHEN ok AND k % 4 = 1 THEN src END AS source_ip, CAST(NULL AS VARCHAR) AS destination_ip,
  CASE WHEN ok AND k % 4 = 1 THEN size END AS block_size,
  CASE WHEN NOT ok THEN 'Traceback (most recent call last):' ELSE [
   '[instance: ' || uuid || '] VM Started (Lifecycle Event)',
   src || ' "GET /v2/54fadb412c4e40cdbaed9335e4c35a9e/servers/detail HTTP/1.1" status: 200 len: ' || size || ' time: 0.24',
   '[instance: ' || uuid || '] Took ' || size || ' seconds to spawn the instance on the hypervisor.',
   'Unknown base file: /var/lib/nova/instances/_base/' || k][k % 4 + 1] END AS raw_message
FROM (SELECT *, k <> 98 AS ok, {request} AS with_request, 'b9000564-fe1a-409b-b8cc-' || lpad(lower(to_hex(user_id)), 12, '0') AS uuid,
        '10.0.' || (user_id % 7) || '.' || (k % 20) AS src, CAST(floor(value) AS BIGINT) AS size
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def apache_lines(spark: SparkSession, folder: str) -> DataFrame:
    wording = [
        F.concat(F.lit("[client "), "src", F.lit("] File does not exist: /var/www/html/p"), "k"),
        F.concat(F.lit("jk2_init() Found child "), "size", F.lit(" in scoreboard slot 9")),
        F.concat(F.lit("mod_jk child workerEnv in error state "), "k"),
        F.lit("LDAP: Built with OpenLDAP LDAP SDK"),
        F.concat(F.lit("(32)Broken pipe: write to "), "dst", F.lit(" failed")),
    ]
    message = F.element_at(F.array(*wording), F.col("k") % 5 + 1)
    stamp = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss yyyy"))
    line = F.concat(F.lit("["), stamp, F.lit("] ["), F.lower("level"), F.lit("] "), message)
    return _lines(events(spark, folder), F.when(F.col("k") == 97, F.lit("script not found or unable to stat")).otherwise(line))


APACHE_SQL = """SELECT event_id AS arrival_seq,
  CASE WHEN ok THEN strftime(ts, '%Y-%m-%d') END AS date, CASE WHEN ok THEN strftime(ts, '%H:%M:%S') END AS time,
  CASE WHEN ok THEN 0::BIGINT END AS pid,
  CASE WHEN ok THEN CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END END AS log_level,
  CASE WHEN ok THEN ['client', 'jk2_init', 'mod_jk', 'LDAP', 'core'][k % 5 + 1] END AS component,
  CASE WHEN NOT ok THEN 'OTHER' ELSE ['File does not exist: <path>', 'jk2_init() Found child <n> in scoreboard slot <n>',
    'mod_jk child workerEnv in error state <n>', 'LDAP: Built with OpenLDAP LDAP SDK',
    '(<n>)Broken pipe: write to <ip> failed'][k % 5 + 1] END AS event_type,
  CASE WHEN ok THEN 'win-' || strftime(time_bucket(INTERVAL '60 seconds', ts), '%Y%m%dT%H%M%S') END AS block_id,
  CASE WHEN ok AND k % 5 = 0 THEN src END AS source_ip, CAST(NULL AS VARCHAR) AS destination_ip, CAST(NULL AS BIGINT) AS block_size,
  CASE WHEN NOT ok THEN 'script not found or unable to stat' ELSE [
   '[client ' || src || '] File does not exist: /var/www/html/p' || k, 'jk2_init() Found child ' || size || ' in scoreboard slot 9',
   'mod_jk child workerEnv in error state ' || k, 'LDAP: Built with OpenLDAP LDAP SDK',
   '(32)Broken pipe: write to ' || dst || ' failed'][k % 5 + 1] END AS raw_message
FROM (SELECT *, k <> 97 AS ok, '10.0.' || (user_id % 7) || '.' || (k % 20) AS src, '10.1.0.' || (k % 10) AS dst,
        CAST(floor(value) AS BIGINT) AS size
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def django_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = F.element_at(F.array(
        F.concat(F.lit("/api/orders/"), "k", F.lit("/lines/"), "user_id"), F.concat(F.lit("/api/search?q="), "k"),
        F.lit("/api/cart"), F.concat(F.lit("/api/v2/items/"), "k")), F.col("k") % 4 + 1)
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    detail = F.when(F.col("k") % 11 == 0, " Slow request").when(F.col("event_type") == "error", " Internal Server Error").otherwise("")
    line = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit("] "), "level", F.lit(" django.request user="), "user_id",
        F.lit(" ip="), "src", F.lit(' "GET '), path, F.lit(' HTTP/1.1" '), status, F.lit(" "), "size", F.lit(" "), "k", F.lit("ms"), detail)
    return _lines(events(spark, folder), F.when(F.col("k") == 96, F.lit("[broken")).otherwise(line))


DJANGO_SQL = """SELECT event_id AS arrival_seq,
  CASE WHEN ok THEN strftime(ts, '%Y-%m-%d') END AS date, CASE WHEN ok THEN strftime(ts, '%H:%M:%S') END AS time,
  CASE WHEN ok THEN 0::BIGINT END AS pid,
  CASE WHEN ok THEN CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END END AS log_level,
  CASE WHEN ok THEN 'django.request' END AS component,
  CASE WHEN NOT ok THEN 'OTHER' ELSE 'GET ' || ['/api/orders/<n>/lines/<n>', '/api/search', '/api/cart', '/api/v2/items/<n>'][k % 4 + 1]
    || ' ' || status || CASE WHEN k % 11 = 0 THEN ' SLOW' ELSE '' END END AS event_type,
  CASE WHEN ok THEN 'user-' || user_id END AS block_id, CASE WHEN ok THEN src END AS source_ip, CAST(NULL AS VARCHAR) AS destination_ip,
  CASE WHEN ok THEN size END AS block_size,
  CASE WHEN NOT ok THEN '[broken' ELSE CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END
    || ' django.request user=' || user_id || ' ip=' || src || ' "GET '
    || ['/api/orders/' || k || '/lines/' || user_id, '/api/search?q=' || k, '/api/cart', '/api/v2/items/' || k][k % 4 + 1]
    || ' HTTP/1.1" ' || status || ' ' || size || ' ' || k || 'ms'
    || CASE WHEN k % 11 = 0 THEN ' Slow request' WHEN event_type = 'error' THEN ' Internal Server Error' ELSE '' END END AS raw_message
FROM (SELECT *, k <> 96 AS ok, '10.0.' || (user_id % 7) || '.' || (k % 20) AS src, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
        CAST(floor(value) AS BIGINT) AS size
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def audit_records(spark: SparkSession, folder: str) -> DataFrame:
    """Audit records as JSON text, one per event."""
    kind, k = F.col("event_type"), F.col("k")
    identity = F.struct(
        F.when(k % 4 == 0, "Anonymous").when(k % 4 == 3, "Root").otherwise("IAMUser").alias("type"),
        F.when(k % 4 == 1, F.concat(F.lit("arn:aws:iam::1:user/u"), "user_id")).alias("arn"),
        F.when(k % 4 == 2, F.concat(F.lit("AKIA"), "user_id")).alias("accessKeyId"),
        F.when(k % 4 == 3, "777").alias("accountId"))
    record = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"),
        F.concat(F.element_at(F.array(F.lit("iam"), F.lit("s3"), F.lit("ec2")), k % 3 + 1), F.lit(".amazonaws.com")).alias("eventSource"),
        F.element_at(F.array(F.lit("CreateUser"), F.lit("PutBucketPolicy"), F.lit("ListUsers"), F.lit("RunInstances")), k % 4 + 1).alias("eventName"),
        F.col("src").alias("sourceIPAddress"), F.when(kind == "error", "AccessDenied").alias("errorCode"),
        F.concat(F.lit("e-"), F.col(ARRIVAL_SEQ)).alias("eventID"), identity.alias("userIdentity"))
    return events(spark, folder).select(ARRIVAL_SEQ, F.to_json(record).alias("value"))


AUDIT_SQL = """SELECT event_id AS arrival_seq, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, 0::BIGINT AS pid,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS log_level,
  ['iam', 's3', 'ec2'][k % 3 + 1] || '.amazonaws.com' AS component,
  ['CreateUser', 'PutBucketPolicy', 'ListUsers', 'RunInstances'][k % 4 + 1] AS event_type,
  CASE k % 4 WHEN 0 THEN 'anonymous@' || src WHEN 1 THEN 'arn:aws:iam::1:user/u' || user_id WHEN 2 THEN 'AKIA' || user_id ELSE 'Root:777' END
    || '|' || strftime(ts, '%Y%m%dT%H') AS block_id,
  src AS source_ip, CAST(NULL AS VARCHAR) AS destination_ip, CAST(NULL AS BIGINT) AS block_size,
  'eventID=e-' || event_id || ' errorCode=' || CASE WHEN event_type = 'error' THEN 'AccessDenied' ELSE '-' END AS raw_message
FROM (SELECT *, '10.0.' || (user_id % 7) || '.' || (k % 20) AS src
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
