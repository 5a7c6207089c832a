"""Deterministic sharded WARC files, and reading them back.

Pages are sorted by id. Shards are ranges of that order of about SHARD_BYTES, cut by the exact
running sum of payload and header bytes, so they are the same at every run and on every
cluster. Payloads travel to their shard once; headers, record ids and digests are made there, and each
record is compressed as a gzip member of its own. One task writes a shard's members in order and goes on
to the next file when a file reaches FILE_BYTES compressed.

Files are written under temporary names. What a task has written is known only through the
manifest row it returns, and Spark takes the rows of one attempt of each task; so what a lost
or repeated attempt has written is never listed. The listed files get their final names, the
manifest is written last, and readers open only what it lists.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from loggrove.llm.registry import query, table
from loggrove.llm.textcols import slices
from loggrove.operators.ordering import ranked
from loggrove.scratch import scratch_path, written

SHARD_BYTES = 32 << 20  # payload of a shard, at which the range of the next begins
FILE_BYTES = 8 << 20  # compressed bytes at which a file is full
HEADER_BYTES = 768  # counted for each record beside its payload, so that runs of revisits or empty pages fill shards too
LEAST_REVISIT = 1000  # payloads of fewer bytes are always stored
DATE = "1970-01-01T00:00:00Z"  # pages carry no date; a fixed one keeps files the same at each run
LEVEL = 6
MOST_READERS = 10_000  # tasks that read files at once
NO_ID = -(1 << 63)  # stands for a null id, first in order

# Names of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path; object stores under their Hadoop names too."""
    for hadoop, plain in (("s3a://", "s3://"), ("s3n://", "s3://")):
        path = path.replace(hadoop, plain, 1) if path.startswith(hadoop) else path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def decided(pages: DataFrame) -> DataFrame:
    """Per distinct (id, payload): ``shard``, and ``leader``, the id of the response it revisits, or null."""
    small = written(pages.select("page", "sha", "bytes").groupBy("page", "sha", "bytes").agg(F.count(F.lit(1)).alias("rows")), "payloads")
    repeated = small.where(F.col("bytes") >= LEAST_REVISIT).groupBy("sha").agg(F.max("page").alias("leader"), F.sum("rows").alias("n")).where("n > 1")
    led = small.join(repeated.drop("n"), "sha", "left")
    payload = F.when(F.col("leader").isNull() | (F.col("leader") == F.col("page")), F.col("bytes")).otherwise(F.lit(0))
    stored = payload + F.lit(HEADER_BYTES)
    placed = ranked(led, [F.col("page"), F.col("sha")], totals={"upto": stored})
    return placed.select("page", "sha", "leader", F.floor((F.col("upto") - stored) / F.lit(SHARD_BYTES)).alias("shard"))


def _record_id(page: int, sha: str, turn: int) -> str:
    """Names a page's id and payload, so that two payloads of one id are told apart."""
    return f"<{ID_PREFIX}{'null' if page == NO_ID else page}:{sha[:16]}{f':{turn}' if turn else ''}>"


def _of_record_id(text: str) -> int | None:
    name = text.strip("<>")[len(ID_PREFIX):].split(":")[0]
    return None if name == "null" else int(name)


def _headers(first: str, fields: list[tuple[str, str]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _target(url: str | None) -> list[tuple[str, str]]:
    if url is None:
        return []
    return [("WARC-Target-URI", "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url))]


def record(page: int, sha: str, turn: int, url: str | None, payload: bytes, leader: int | None) -> bytes:
    """One record. A revisit has the HTTP header only, and the payload's length in a field of its own."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if leader is not None else http + payload
    fields = [("WARC-Type", "response" if leader is None else "revisit"), ("WARC-Record-ID", _record_id(page, sha, turn)), ("WARC-Date", DATE), *_target(url),
              ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if leader is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(leader, sha, 0)), ("X-Payload-Length", str(len(payload)))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _headers(VERSION, fields) + block + b"\r\n\r\n"


def _file_head(name: str) -> bytes:
    body = b"software: loggrove\r\nformat: WARC File Format 1.1\r\n"
    return _headers(VERSION, [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name),
                              ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]) + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    return gzip.compress(data, LEVEL, mtime=0)


class _Shard:
    """Writes one shard's files under temporary names."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.system, self.folder = _filesystem(folder)
        self.shard, self.limit, self.number, self.rows, self.out = shard, limit, 0, [], None

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:08d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{uuid.uuid4().hex}-{self.name}"
            self.system.create_dir(f"{self.folder}/_temporary", recursive=True)
            self.out, self.size, self.records, self.digest = self.system.open_output_stream(f"{self.folder}/{self.temporary}", compression=None), 0, 0, hashlib.sha256()
            self._put(_member(_file_head(self.name)))
        self._put(member)
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.name, self.temporary, self.records, self.size, self.digest.hexdigest()))
            self.number, self.out = self.number + 1, None

    def listed(self) -> pa.RecordBatch:
        """Manifest rows of the shard's files, which are closed."""
        self.close()
        columns = zip(*self.rows)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["name", "temporary", "records", "bytes", "sha256"])


MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"


def _dealt(staged: DataFrame, choices: DataFrame) -> DataFrame:
    """Payloads and choices by shard. Payloads travel once, straight to their shard. There the choice for an id and
    payload comes ahead of its rows, in the order of their urls."""
    # The first (page, sha) of each shard: one row for SHARD_BYTES of records.
    firsts = sorted((r["first"]["page"], r["first"]["sha"], r["shard"]) for r in choices.groupBy("shard").agg(F.min(F.struct("page", "sha")).alias("first")).collect())
    bounds, shards = [(page, sha) for page, sha, _ in firsts], [shard for _, _, shard in firsts]

    def addressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            shas = [hashlib.sha256(payload.as_buffer()).hexdigest() for payload in batch.column("payload")]
            at = [shards[bisect_right(bounds, key) - 1] for key in zip(batch.column("page").to_pylist(), shas)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), batch.column("page"), pa.array(shas, pa.string()), batch.column("url"), batch.column("payload")],
                ["shard", "page", "sha", "url", "payload"])

    payloads = staged.mapInArrow(addressed, "shard long, page long, sha string, url string, payload binary")
    rows = payloads.withColumn("leader", F.lit(None).cast("long")).unionByName(
        choices.select("shard", "page", "sha", "leader", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload")))
    return rows.repartition("shard").sortWithinPartitions("shard", "page", "sha", F.col("payload").isNotNull(), "url")


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html) into ``folder`` and return the manifest.

    Of pages with equal payloads of at least 1000 bytes the one with the largest id is stored as a
    response, the others as revisits of it.

    * A null html is an empty payload; a null url leaves its header out; a null id is written as null.
    * Of equal rows of one id the first is the record that others revisit; the rest revisit it too if the
      payload is long enough, and are stored again if not.
    * An empty table gives an empty manifest. Very long payloads take memory of a few times their size.
    * Other columns are not read.
    """
    spark = pages.sparkSession
    staged = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = staged.withColumn("sha", F.sha2("payload", 256))
    choices = written(decided(keyed.select("page", "sha", F.octet_length("payload").cast("long").alias("bytes"))), "choices")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader, turn = None, None, 0
        for batch in slices(batches, "payload"):
            columns = (batch.column(c).to_pylist() for c in ("shard", "page", "sha", "url", "leader"))
            for shard, page, sha, url, said, payload in zip(*columns, batch.column("payload")):
                if not payload.is_valid:  # the choice for the rows that follow
                    leader, turn = said, 0
                    continue
                if at is None or at.shard != shard:
                    if at is not None:
                        yield at.listed()
                    at = _Shard(folder, shard, file_bytes)
                at.add(_member(record(page, sha, turn, url, payload.as_py(), None if leader == page and not turn else leader)))
                turn += 1
        if at is not None:
            yield at.listed()

    manifest = written(_dealt(staged, choices).mapInArrow(store, MANIFEST), "manifest")
    _commit(spark, manifest, folder)
    return manifest.drop("temporary")


def _commit(spark: SparkSession, manifest: DataFrame, folder: str) -> None:
    """Give the listed files their names, then write the manifest. Both can be repeated."""

    def rename(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _filesystem(folder)
        for frame in frames:
            for name, temporary in zip(frame["name"], frame["temporary"]):
                if system.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:
                    system.move(f"{root}/{temporary}", f"{root}/{name}")
            yield frame

    manifest.mapInPandas(rename, MANIFEST).select("name", "records", "bytes", "sha256").write.json(f"{folder}/_manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a file of gzip members, one member at a time."""
    rest = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            chunk = rest or stream.read(1 << 18)
            rest = b""
            if not chunk:
                if parts:
                    raise ValueError("a record is cut off")
                return
            parts.append(inflate.decompress(chunk))
        rest = inflate.unused_data
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"not a record: {lines[0][:40]}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if body[size:] != b"\r\n\r\n":
            raise ValueError(f"record {headers['WARC-Record-ID']} has a wrong length")
        yield headers, body[:size]


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, name string"


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest in ``folder`` lists, one file at a time in a task.

    Digests and lengths are taken from the bytes that are there and must agree with the headers; a
    revisit has no payload, and gives those of its headers.
    """
    listed = spark.read.schema("name string, records long, bytes long, sha256 string").json(f"{folder}/_manifest")
    tasks = min(max(1, listed.count()), MOST_READERS)  # the list is small, what it lists is not

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _filesystem(folder)
        names = [x.split(" ")[0] for x in RECORD.split(", ")]
        for frame in frames:
            for name, records in zip(frame["name"], frame["records"]):
                rows, held, seen = [], 0, 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in _records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        seen += 1
                        claimed = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        payload = block.partition(b"\r\n\r\n")[2]
                        revisit = headers["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != claimed:
                            raise ValueError(f"record {headers['WARC-Record-ID']} in {name} is damaged")
                        rows.append((
                            _of_record_id(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"],
                            _of_record_id(headers["WARC-Refers-To"]) if revisit else None,
                            int(headers["X-Payload-Length"]) if revisit else len(payload), claimed, None if revisit or not payloads else payload, name))
                        held += len(payload) if payloads else 64
                        if held > 1 << 22:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name} holds {seen} records, the manifest says {records}")
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return listed.repartition(tasks, "name").mapInPandas(run, RECORD)


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
q AS (SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS leader FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN leader <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN leader <> page_id THEN leader END AS refers_to FROM q
"""


@query(SQL)
def op2_warc_round_trip(spark, folder):
    archives = scratch_path(spark, "warc")
    write(table(spark, folder, "pages"), archives)
    return read(spark, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
