import glob
import gzip
import hashlib
import os

import pytest

from common import crowded, rows
from loggrove.llm import warc

PAGES = [
    (1, "http://a.example/x", "same " * 300), (2, "http://a.example/y", "same " * 300), (9, None, "same " * 300), (3, "http://b.example/\r\nX: y z", "short"),
    (4, "http://c.example/é", "short"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 600), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (10, "u", "long " * 40_000),
    (11, "u", "x" * 999), (12, "u", "x" * 999), (13, "u", "x" * 1000), (14, "u", "x" * 1000),
]


def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)


def wanted(data):
    out = []
    for page, _, html in data:
        payload = (html or "").encode()
        leader = max((p for p, _, h in data if (h or "") == (html or "")), default=None) if len(payload) >= 1000 else page
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response" if leader == page else "revisit", None if leader == page else leader))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def contents(folder):
    return {os.path.basename(f): open(f, "rb").read() for f in glob.glob(f"{folder}/*.warc.gz")}


def test_round_trip(spark, tmp_path):
    manifest = warc.write(crowded(pages(spark, PAGES)), f"file://{tmp_path}/w", file_bytes=300)
    listed = {r["name"]: r for r in manifest.collect()}
    back = warc.read(spark, f"file://{tmp_path}/w")
    assert rows(back, *COLUMNS) == wanted(PAGES)
    payloads = {r["page_id"]: r["payload"] for r in back.collect() if r["record_type"] == "response"}
    assert all(bytes(payloads[p]) == (h or "").encode() for p, _, h in PAGES if p in payloads)
    files = contents(f"{tmp_path}/w")
    assert set(files) == set(listed) and len(files) > 1
    for name, data in files.items():
        assert len(data) == listed[name]["bytes"] and hashlib.sha256(data).hexdigest() == listed[name]["sha256"]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    urls = {r["page_id"]: r["url"] for r in back.collect()}
    assert urls[3] == "http://b.example/%0D%0AX:%20y%20z" and urls[9] is None and urls[4] == "http://c.example/é"


def test_same_files_at_every_run_and_partitioning(spread, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 2000)
    warc.write(pages(spread, PAGES), str(tmp_path / "a"))
    spread.conf.set("spark.sql.shuffle.partitions", "3")
    warc.write(pages(spread, PAGES[::-1]).coalesce(1), str(tmp_path / "b"))
    first = contents(tmp_path / "a")
    assert len(first) > 2 and first == contents(tmp_path / "b")


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write(pages(spark, PAGES), folder)
    open(f"{folder}/_temporary/lost-pages-00000000-00000.warc.gz", "wb").write(b"half a file")
    open(f"{folder}/pages-99999999-00000.warc.gz", "wb").write(b"not listed")
    assert rows(warc.read(spark, folder), *COLUMNS) == wanted(PAGES)


def test_damage_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write(pages(spark, PAGES[:3]), folder)
    name = next(iter(contents(folder)))
    data = gzip.decompress(contents(folder)[name]).replace(b"same same", b"same lame", 1)
    open(f"{folder}/{name}", "wb").write(gzip.compress(data))
    with pytest.raises(Exception, match="damaged|wrong length"):
        warc.read(spark, folder).collect()


def test_null_and_repeated_ids(spark, tmp_path):
    long, other = "a" * 2000, "b" * 2000
    data = [(None, "u", long), (1, "u", long), (1, "u", long), (2, "u", other), (2, "v", long), (3, None, None), (3, None, None)]
    warc.write(pages(spark, data), str(tmp_path / "w"))
    found = rows(warc.read(spark, str(tmp_path / "w")), "page_id", "payload_bytes", "record_type", "refers_to")
    assert found == sorted([(None, 2000, "revisit", 2), (1, 2000, "revisit", 2), (1, 2000, "revisit", 2), (2, 2000, "response", None), (2, 2000, "response", None),
                            (3, 0, "response", None), (3, 0, "response", None)], key=repr)


def test_empty_table(spark, tmp_path):
    assert warc.write(pages(spark, PAGES).where("false"), str(tmp_path / "w")).count() == 0
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def test_runs_of_revisits_and_empty_pages_fill_shards(spark, monkeypatch):
    """Records without a payload of their own count with their headers, so no shard holds a whole run."""
    monkeypatch.setattr(warc, "SHARD_BYTES", 20_000)
    same, empty = "0" * 40, "1" * 40
    listed = [(i, same, 5000) for i in range(400)] + [(1000 + i, empty, 0) for i in range(400)]
    found = warc.decided(spark.createDataFrame(listed, "page long, sha string, bytes long")).groupBy("shard").count().collect()
    assert len(found) > 20 and max(r["count"] for r in found) <= 30


def test_payloads_travel_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(warc, "SHARD_BYTES", 2000)
    staged = pages(spark, PAGES).select(F.col("page_id").alias("page"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    staged = warc.written(staged, "staged")
    choices = warc.written(warc.decided(staged.select("page", F.sha2("payload", 256).alias("sha"), F.octet_length("payload").cast("long").alias("bytes"))), "choices")
    dealt = warc._dealt(staged, choices)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    of = {(r["page"], r["sha"]): r["shard"] for r in choices.collect()}
    found = dealt.collect()
    assert len(set(of.values())) > 2 and all(of[r["page"], r["sha"]] == r["shard"] for r in found)
    assert len(found) == len(of) + len(PAGES)
