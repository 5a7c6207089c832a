"""A stream source of files that grow: lines appended to the files of a folder.

An offset is, for every file, the byte after the last complete line seen. What lies between two
offsets is cut into byte ranges, each read by one task; a line belongs to the range it begins in,
whose task reads on to the line's end. A line without its line feed yet waits for a later batch,
so a writer that is caught in the middle of a line does no harm.

Files are opened through Arrow's file systems (local, HDFS, S3, GCS), by the driver to look for
line ends and by the tasks. A file that is shorter than before has been begun anew and is read
from its start; one that has gone gives nothing more. Names beginning with . or _ are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loggrove.schema import ARRIVAL_CHUNK, ARRIVAL_SEQ

LINES = f"{ARRIVAL_CHUNK} string, {ARRIVAL_SEQ} long, value string"
SPLIT_BYTES = 64 << 20  # of a file, read by one task
_PIECE = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _after_last_line(system: fs.FileSystem, path: str, size: int, least: int) -> int:
    """The byte after the last line feed between ``least`` and the file's end, or ``least``."""
    with system.open_input_file(path) as file:
        end = size
        while end > least:
            start = max(least, end - _PIECE)
            at = file.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return least


@dataclass
class ByteRange(InputPartition):
    """Bytes of a file whose lines one task reads. ``begins``: a line begins at ``start``; ``limit``: the last line's end."""

    path: str
    start: int
    end: int
    limit: int
    begins: bool

    def __post_init__(self):
        super().__init__((self.path, self.start, self.end))


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.known: dict[str, int] = {}  # spares looking through what earlier offsets have settled

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = opened(self.folder)
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name[:1] not in "._":
                before = self.known.get(info.path, 0)
                found[info.path] = _after_last_line(system, info.path, info.size, before if before <= info.size else 0)
        self.known = found
        return found

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        ranges = []
        for path, upto in sorted(end.items()):
            first = start.get(path, 0)
            if first > upto:  # begun anew
                first = 0
            ranges += [ByteRange(path, at, min(at + self.split, upto), upto, at == first) for at in range(first, upto, self.split)]
        return ranges

    def read(self, partition: ByteRange):
        system, _ = opened(self.folder)
        with system.open_input_file(partition.path) as file:
            # From the byte before: a line begins here only if that is a line feed.
            at = partition.start if partition.begins else partition.start - 1
            held, skipping = b"", not partition.begins
            place = at  # where ``held`` begins
            while place < partition.end or held:
                piece = file.read_at(min(_PIECE, partition.limit - at), at) if at < partition.limit else b""
                at += len(piece)
                held += piece
                if skipping:
                    cut = held.find(b"\n")
                    if cut < 0:
                        place, held = place + len(held), b""
                        if not piece:
                            return
                        continue
                    place, held, skipping = place + cut + 1, held[cut + 1:], False
                whole = held.rfind(b"\n") + 1
                values, numbers = [], []
                used = 0
                while used < whole and place + used < partition.end:
                    stop = held.index(b"\n", used)
                    values.append(held[used:stop].removesuffix(b"\r").decode("utf-8", "replace"))
                    numbers.append(place + used)
                    used = stop + 1
                if values:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([partition.path] * len(values)), pa.array(numbers, pa.int64()), pa.array(values, pa.string())], [ARRIVAL_CHUNK, ARRIVAL_SEQ, "value"])
                place, held = place + used, held[used:]
                if place >= partition.end or not piece:
                    return

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
