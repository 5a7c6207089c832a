"""A batch source of audit records: the elements of the ``Records`` lists in JSON files.

Whether a file is gzip is told by its first two bytes, not by its name. A file is read piece by
piece and its records are handed on as they are complete, so neither a file nor a document is ever
one value. A file may hold several documents one after the other. Small files share a task.
"""

from __future__ import annotations

import codecs
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loggrove.schema import ARRIVAL_CHUNK, ARRIVAL_SEQ
from loggrove.sources.tail import opened

TASK_BYTES = 64 << 20  # of small files that one task reads
BATCH = 4096
_PIECE = 1 << 20
_LIST = re.compile(r'"Records"\s*:\s*\[')
_BETWEEN = re.compile(r"[\s,]*")


def _texts(file) -> Iterator[str]:
    """The text of an open file in pieces; bytes that are no UTF-8 are replaced."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    first = file.read(_PIECE)
    unpacker = zlib.decompressobj(31) if first[:2] == b"\x1f\x8b" else None
    piece = first
    while piece:
        while unpacker is not None and piece:
            data = unpacker.decompress(piece, _PIECE)
            yield decode(data)
            piece = unpacker.unconsumed_tail
            if unpacker.eof:  # members may follow one another
                piece, unpacker = unpacker.unused_data, zlib.decompressobj(31)
        if unpacker is None:
            yield decode(piece)
        piece = file.read(_PIECE)


def elements(texts: Iterator[str]) -> Iterator[str]:
    """The elements of all ``Records`` lists in the text, as they stand there.

    A list that breaks off, or in which something is no JSON, gives the elements before that.
    """
    texts, held, at, inside = iter(texts), "", 0, False
    parse, wanted = json.JSONDecoder().raw_decode, 1
    while True:
        if inside:
            at = _BETWEEN.match(held, at).end()
            if held[at:at + 1] == "]":
                inside, at = False, at + 1
                continue
            try:
                end = parse(held, at)[1]
            except json.JSONDecodeError:
                pass
            else:
                if end < len(held):  # a number at the very end might go on
                    yield held[at:end]
                    at, wanted = end, 1
                    continue
        else:
            found = _LIST.search(held, at)
            if found:
                inside, at = True, found.end()
                continue
            at = max(at, held.rfind('"Records"', at) if '"Records"' in held[at:] else len(held) - len('"Records"'))
        # What is held grows twofold for each try, so a long element is not read over and over.
        more = []
        for text in texts:
            more.append(text)
            if sum(map(len, more)) >= wanted:
                break
        if not more:
            return
        held, at = held[at:] + "".join(more), 0
        wanted = len(held)


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __post_init__(self):
        super().__init__(tuple(self.paths))


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.roots = json.loads(options["paths"])

    def partitions(self) -> list[Files]:
        """Files in the order of their names, small ones together."""
        found = []
        for root in self.roots:
            system, path = opened(root)
            info = system.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(root)
            listed = system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
            scheme = root.split("://")[0] + "://" if "://" in root else ""
            found += [(scheme + i.path, i.size) for i in sorted(listed, key=lambda i: i.path)
                      if i.type == fs.FileType.File and i.base_name[:1] not in "._"]
        groups, size = [[]], 0
        for path, bytes_ in found:
            if groups[-1] and size + bytes_ > TASK_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += bytes_
        return [Files(g) for g in groups]

    def read(self, partition: Files):
        for path in partition.paths:
            system, plain = opened(path)
            held, number = [], 0
            with system.open_input_stream(plain, compression=None) as file:
                for element in elements(_texts(file)):
                    held.append(element)
                    if len(held) == BATCH:
                        yield _batch(path, number, held)
                        number, held = number + len(held), []
            if held:
                yield _batch(path, number, held)


def _batch(path: str, first: int, values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(values)), pa.array(range(first, first + len(values)), pa.int64()), pa.array(values, pa.string())], [ARRIVAL_CHUNK, ARRIVAL_SEQ, "value"])


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audit_records"

    def schema(self) -> str:
        return f"{ARRIVAL_CHUNK} string, {ARRIVAL_SEQ} long, value string"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)
