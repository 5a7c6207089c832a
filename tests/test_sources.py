import gzip
import json

import pytest
from pyspark.sql import functions as F

from loggrove.functions.templates import normalize_template
from loggrove.sources import apache, cloudtrail
from loggrove.sources.lines import first_lines, read_lines, syslog_message
from loggrove.sources.registry import get_source, parse, read_source

TAXONOMY = {
    "Receiving block blk_1 src: /10.250.19.102:54106 dest: /10.250.19.102:50010": "RECEIVE_BLOCK",
    "Received block blk_1 of size 91178 from /10.250.10.6": "RECEIVED_BLOCK",
    "PacketResponder 1 for block blk_1 terminating": "PACKET_TERMINATED",
    "BLOCK* NameSystem.allocateBlock: /user/root/x. blk_1": "ALLOCATE_BLOCK",
    "BLOCK* NameSystem.addStoredBlock: blockMap updated: 10.251.73.220:50010 is added to blk_1 size 67108864": "STORE_BLOCK",
    "10.250.10.6:50010 Served block blk_1 to /10.250.10.7": "SERVE_BLOCK",
    "10.250.10.6:50010:Starting thread to transfer block blk_1 to 10.250.10.7:50010": "START_TRANSFER",
    "10.250.10.6:50010:Transmitted block blk_1 to /10.250.10.7:50010": "TRANSMIT_BLOCK",
    "BLOCK* ask 10.250.10.6:50010 to replicate blk_1 to datanode(s) 10.250.10.7:50010": "REPLICATE_BLOCK",
    "Verification succeeded for blk_1": "OTHER",
}


def rows_of(spark, lines, source, **options):
    frame = spark.createDataFrame(list(enumerate(lines)), "arrival_seq long, value string")
    return [r.asDict() for r in parse(frame, source, **options).orderBy("arrival_seq").collect()]


def test_hdfs_line(spark):
    (row,) = rows_of(spark, [
        "081109 203519 145 INFO dfs.DataNode$PacketResponder: Received block blk_-1608999687919862906 of size 91178 from /10.250.10.6"], "hdfs")
    assert (row["date"], row["time"], row["pid"]) == ("2008-11-09", "20:35:19", 145)
    assert row["event_type"] == "RECEIVED_BLOCK" and row["component"] == "dfs.DataNode$PacketResponder"
    assert row["block_id"] == "blk_-1608999687919862906" and row["block_size"] == 91178
    assert row["source_ip"] == "10.250.10.6" and row["destination_ip"] is None


def test_hdfs_taxonomy_and_addresses(spark):
    rows = rows_of(spark, [f"081109 203519 145 INFO dfs.X: {m}" for m in TAXONOMY], "hdfs")
    assert [r["event_type"] for r in rows] == list(TAXONOMY.values())
    assert rows[0]["source_ip"] == "10.250.19.102" and rows[0]["destination_ip"] == "10.250.19.102"
    assert rows[4]["source_ip"] == "10.251.73.220" and rows[4]["block_size"] == 67108864
    assert rows[8]["source_ip"] == "10.250.10.6" and rows[8]["destination_ip"] == "10.250.10.7"


def test_hdfs_unmatched_line_still_gives_a_row(spark):
    rows = rows_of(spark, ["java.io.IOException: blk_9 of size 12 from /10.0.0.1", "\x01a\x01b\x01c\x01d\x01e\x01f\x01g", ""], "hdfs")
    assert rows[0]["date"] is None and rows[0]["event_type"] == "OTHER" and rows[0]["block_id"] == "blk_9"
    assert rows[0]["block_size"] == 12 and rows[0]["source_ip"] == "10.0.0.1"
    assert rows[1]["date"] is None and rows[1]["raw_message"].startswith("\x01")
    assert rows[2]["raw_message"] == ""


def test_control_characters_in_a_message_survive(spark):
    (row,) = rows_of(spark, ["081109 203519 145 INFO dfs.X: Served block blk_1 \x01 to \x01 end"], "hdfs")
    assert row["raw_message"] == "Served block blk_1 \x01 to \x01 end" and row["event_type"] == "SERVE_BLOCK"


UUID = "b9000564-fe1a-409b-b8cc-1e88b294cd1d"
REQUEST = "req-38101a0b-2096-447d-96ea-a692162415ae"


def test_openstack_blocks(spark):
    head = "nova.log 2017-05-16 00:00:04.500 2931 INFO nova.compute.manager"
    lines = [f"{head} [{REQUEST} u t - - -] [instance: {UUID}] VM Started (Lifecycle Event)",
             f'{head} [{REQUEST} u t - - -] 10.11.10.1 "GET /v2/x/detail HTTP/1.1" status: 200 len: 1893 time: 0.24',
             f"{head} [-] plain words", "Traceback"]
    rows = rows_of(spark, lines, "openstack")
    assert [r["block_id"] for r in rows] == [UUID, None, None, None]
    assert rows[0]["event_type"] == "VM Started (Lifecycle Event)" and rows[0]["time"] == "00:00:04"
    assert rows[1]["block_size"] == 1893 and rows[1]["source_ip"] == "10.11.10.1"
    assert rows[3]["date"] is None
    assert rows_of(spark, lines, "openstack", fallback_to_request_id=True)[1]["block_id"] == REQUEST


def test_apache_components_and_windows(spark):
    rows = rows_of(spark, [
        "[Thu Jun 09 06:07:04 2005] [notice] LDAP: Built with OpenLDAP LDAP SDK",
        "[Fri Jun 10 03:37:39 2005] [error] [client 194.116.250.2] File does not exist: /var/www/html/sumthin",
        "[Fri Jun 10 03:37:59 2005] [error] jk2_init() Found child 30770 in scoreboard slot 9",
        "script not found or unable to stat", "[Sun Feb 30 03:37:59 2005] [error] (2)No such day"], "apache")
    assert [r["component"] for r in rows[:3]] == ["LDAP", "client", "jk2_init"]
    assert rows[1]["event_type"] == "File does not exist: <path>" and rows[1]["source_ip"] == "194.116.250.2"
    assert rows[2]["event_type"] == "jk2_init() Found child <n> in scoreboard slot <n>"
    assert rows[1]["block_id"] == rows[2]["block_id"] == "win-20050610T033700"
    assert rows[3]["date"] is None and rows[3]["event_type"] == "OTHER"
    assert rows[4]["date"] is None
    with pytest.raises(ValueError):
        apache.window_block_id(F.lit(None), 0)


def test_django_routes(spark):
    head = "[2026-03-02 14:05:33,120] {} django.request user=88 ip=10.1.2.3"
    rows = rows_of(spark, [
        head.format("INFO") + ' "POST /api/cart HTTP/1.1" 200 1532 45ms',
        head.format("ERROR") + ' "GET /api/products/55 HTTP/1.1" 500 89 1203ms Internal Server Error: /x',
        head.format("WARNING") + ' "GET /api/reports/12?x=1 HTTP/1.1" 200 20431 5230ms Slow request',
        head.format("INFO") + ' "GET /' + "a" * 130 + '/77 HTTP/1.1" 200 1 1ms'], "django")
    assert [r["event_type"] for r in rows[:3]] == ["POST /api/cart 200", "GET /api/products/<n> 500", "GET /api/reports/<n> 200 SLOW"]
    assert rows[0]["block_id"] == "user-88" and rows[0]["block_size"] == 1532
    assert rows[1]["raw_message"].startswith("ERROR django.request user=88")
    assert len(rows[3]["event_type"]) <= 120 and rows[3]["event_type"].startswith("GET <path>")


RECORD = {"eventTime": "2019-08-21T11:25:01Z", "eventSource": "iam.amazonaws.com", "eventName": "CreateUser", "sourceIPAddress": "1.2.3.4",
          "errorCode": "AccessDenied", "eventID": "e1", "userIdentity": {"type": "IAMUser", "arn": "arn:aws:iam::1:user/a"}}


@pytest.mark.parametrize("zipped", [False, True])
def test_audit_files(spark, tmp_path, zipped):
    anonymous = {**RECORD, "userIdentity": {"type": "AWSAccount"}, "errorCode": None}
    key = {**RECORD, "userIdentity": {"type": "IAMUser", "accessKeyId": "AKIA1", "principalId": "P"}}
    account = {**RECORD, "userIdentity": {"type": "Root", "accountId": "77"}}
    broken = {**RECORD, "eventTime": "yesterday"}
    text = json.dumps({"Records": [RECORD, anonymous, key, account, broken]}, indent=1)
    path = tmp_path / ("a.json.gz" if zipped else "a.json")
    path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())
    rows = read_source(spark, "cloudtrail", str(path)).orderBy("arrival_seq").collect()
    assert [r["block_id"] for r in rows] == ["arn:aws:iam::1:user/a|20190821T11", "anonymous@1.2.3.4|20190821T11", "AKIA1|20190821T11",
                                             "Root:77|20190821T11", None]
    assert [r["log_level"] for r in rows[:2]] == ["ERROR", "INFO"]
    assert rows[0]["raw_message"] == "eventID=e1 errorCode=AccessDenied" and rows[1]["raw_message"].endswith("errorCode=-")
    assert rows[4]["date"] is None and rows[4]["event_type"] == "OTHER"


def test_identity_needs_more_than_a_type(spark):
    frame = spark.createDataFrame([(json.dumps({"sourceIPAddress": None}),)], "value string").select(
        F.from_json("value", cloudtrail.RECORD_SCHEMA).alias("record"))
    assert frame.select(cloudtrail.identity(F.col("record"))).first()[0] == "Unknown:unknown"


@pytest.mark.parametrize("text,template", [
    ("File does not exist: /var/www/html/sumthin", "File does not exist: <path>"),
    ("jk2_init() Found child 30770 in scoreboard slot 9", "jk2_init() Found child <n> in scoreboard slot <n>"),
    (f"Terminating {UUID} now", "Terminating <uuid> now"),
    ("from 10.0.0.1:50010  to   10.0.0.2", "from <ip> to <ip>"),
    ("", "<empty>"), (None, "<empty>"), ("   ", "<empty>"), ("x" * 130, "x" * 120),
])
def test_templates(spark, text, template):
    frame = spark.createDataFrame([(text,)], "m string")
    assert frame.select(normalize_template(F.col("m"))).first()[0] == template


@pytest.mark.parametrize("datagram,message", [
    ("<165>1 2003-10-11T22:14:15.003Z host app 12 ID47 - hello there", "hello there"),
    ('<165>1 2003-10-11T22:14:15.003Z host app 12 ID47 [a@1 b="c"][d e="f"] ﻿hello\r\n', "hello"),
    ("<34>Oct 11 22:14:15 mymachine su[12]: 'su root' failed", "'su root' failed"),
    ("plain line", None), ("<34>Oct 11 22:14:15 m su: ", None),
])
def test_syslog(spark, datagram, message):
    frame = spark.createDataFrame([(datagram,)], "m string")
    assert frame.select(syslog_message(F.col("m"))).first()[0] == message


def test_lines_keep_arrival_order_and_replace_bad_bytes(spark, tmp_path):
    for name, start in (("b.log", 100), ("a.log", 0)):
        (tmp_path / name).write_bytes(b"\r\n".join(str(start + i).encode() for i in range(50)) + b"\n\xff!\n")
    lines = read_lines(spark, str(tmp_path), "hdfs")
    values = [r["value"] for r in lines.orderBy("arrival_chunk", "arrival_seq").collect()]
    assert values == [str(i) for i in range(50)] + ["�!"] + [str(100 + i) for i in range(50)] + ["�!"]
    assert [r["value"] for r in first_lines(lines, 3).collect()] == ["0", "1", "2"]


def test_unknown_source():
    with pytest.raises(ValueError, match="unknown source"):
        get_source("syslogd")
    assert get_source("apache").dedupe is False and get_source("django").idle_timeout_seconds is None
