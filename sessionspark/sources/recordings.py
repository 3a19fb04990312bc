"""Recordings of session messages as a data source: `recording`, for batch and stream, read and written.

A file is a row of blocks. A block begins with a mark, the bytes and the number of its messages, and the least and greatest
session in it; a message has its session, number, kind (0 binary, 1 JSON) and length before its bytes. A file is read in
byte ranges: each reads the blocks that begin in it, from the first mark on, so one large recording is many tasks' work.
Equality filters on session pass over blocks that can't hold it. A stream's offset is the length of each file; files appear whole
or grow by whole blocks.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

SCHEMA = "session long, seq long, kind string, payload binary"
# Fixed value: what a block begins with. Sixteen bytes that no sane payload holds; the header behind it is checked too.
MARK = b"\x00\xffREC\r\n\x1a\x97\xd1session"
HEAD, MESSAGE = struct.Struct("<QIqq"), struct.Struct("<qqBI")
KINDS = ("binary", "json")
BLOCK_BYTES, RANGE_BYTES = 1 << 16, 1 << 24


def _open(path: str):
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def files(path: str) -> dict[str, int]:
    """Recordings under path and their lengths."""
    fs, base = _open(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".rec")}


def block(messages: list[tuple[int, int, str, bytes]]) -> bytes:
    """Messages (session, seq, kind, payload) as one block."""
    body = b"".join(MESSAGE.pack(s, n, KINDS.index(kind), len(p)) + p for s, n, kind, p in messages)
    sessions = [m[0] for m in messages]
    return MARK + HEAD.pack(len(body), len(messages), min(sessions), max(sessions)) + body


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end, self.size = path, start, end, size


def ranges(path: str, start: int, end: int, step: int) -> list[Range]:
    return [Range(path, a, min(a + step, end), end) for a in range(start, end, step)]


def _blocks(f, part: Range, session: int | None) -> Iterator[bytes]:
    """Bodies of the blocks that begin in the range."""
    at, chunk = part.start, 1 << 20
    while at < part.end:
        f.seek(at)
        seen = f.read(len(MARK) + HEAD.size)
        if not seen.startswith(MARK) or at + len(MARK) + HEAD.size > part.size or at + len(seen) + HEAD.unpack_from(seen, len(MARK))[0] > part.size:
            # Not at a block: look for the next mark.
            f.seek(at + 1)
            near = f.read(min(chunk, part.end - at - 1 + len(MARK) - 1))
            k = near.find(MARK)
            if k < 0 and at + 1 + len(near) >= part.end:
                return
            at = at + 1 + k if k >= 0 else at + 1 + len(near) - len(MARK) + 1
            continue
        size, _, low, high = HEAD.unpack_from(seen, len(MARK))
        if session is None or low <= session <= high:
            yield f.read(size)
        at += len(seen) + size


def read(part: Range, root: str, session: int | None = None) -> Iterator[pa.RecordBatch]:
    fs, _ = _open(root)
    with fs.open_input_file(part.path) as f:
        for body in _blocks(f, part, session):
            at, out = 0, ([], [], [], [])
            while at < len(body):
                s, n, kind, size = MESSAGE.unpack_from(body, at)
                at += MESSAGE.size
                if session is None or s == session:
                    for column, value in zip(out, (s, n, KINDS[kind], body[at : at + size]), strict=True):
                        column.append(value)
                at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["session", "seq", "kind", "payload"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.step, self.session = options["path"], int(options.get("rangebytes", RANGE_BYTES)), None

    def pushFilters(self, filters: list) -> Iterator:
        """Sessions are looked up by the blocks' heads; every filter but that goes back to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and tuple(f.attribute) == ("session",) and self.session is None:
                self.session = int(f.value)
            else:
                yield f

    def partitions(self) -> list[Range]:
        return [r for path, size in files(self.path).items() for r in ranges(path, 0, size, self.step)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # Spark reads once where there are no partitions
            yield from read(partition, self.path, self.session)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.step = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return files(self.path)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for path, size in end.items() for r in ranges(path, start.get(path, 0), size, self.step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read(partition, self.path)

    def commit(self, end: dict) -> None:
        pass


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None) -> None:
        self.path = path


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.block, self.job = options["path"], int(options.get("blockbytes", BLOCK_BYTES)), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Written:
        """One file for each task, under a name that readers pass over until the job is committed."""
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        path, held, size, some = f"{base}/{self.job}-{uuid.uuid4().hex}.part", [], 0, False
        with fs.open_output_stream(path) as f:
            for row in iterator:
                held.append((row.session, row.seq, row.kind, bytes(row.payload)))
                size, some = size + len(row.payload), True
                if size >= self.block:
                    f.write(block(held))
                    held, size = [], 0
            if held:
                f.write(block(held))
        if not some:
            fs.delete_file(path)
        return _Written(path if some else None)

    def commit(self, messages: list) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None and m.path:
                fs.move(m.path, m.path.removesuffix(".part") + ".rec")

    def abort(self, messages: list) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None and m.path:
                fs.delete_file(m.path)


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known: spark.read.format("recording").load(path); filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)
