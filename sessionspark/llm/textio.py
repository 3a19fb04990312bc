"""Shared helpers: written tables in the cluster's shared folder, and numpy views of Arrow text columns.

Python workers see text as Arrow buffers. Rows are handled in pieces of bounded bytes, so that the
temporary arrays of a task stay small whatever the batch holds; one row is never split.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20

#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes of words under the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
#: Bytes of words under the pattern [^\x20\x09-\x0D]+.
NON_SPACE_BYTES = np.ones(256, bool)
NON_SPACE_BYTES[[32, 9, 10, 11, 12, 13]] = False


#: Tables that save() wrote and drop() hasn't deleted.
_written: set[str] = set()
_local = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local session gets a temporary one; a cluster must name its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def save(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: later steps don't compute it anew, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    if (held := getattr(_local, "scope", None)) is not None:
        held.add(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that save() wrote, on whatever file system they are."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written.discard(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[str], None]]:
    """Tables that this thread saves inside are deleted at the end, but for those whose paths the scope's function was called with."""
    outer, held, kept = getattr(_local, "scope", None), set(), set()
    _local.scope = held
    try:
        yield kept.add
    finally:
        _local.scope = outer
        drop(spark, *(held - kept))
        if outer is not None:
            outer.update(held & kept)


def release(spark: SparkSession) -> None:
    """Delete all tables that this session's operators still hold. Results that read them must have been written before."""
    drop(spark, *list(_written))


def quoted(column: str) -> str:
    """A column's name in a form that dots, spaces and backticks in it don't change."""
    return "`" + column.replace("`", "``") + "`"


def carried(df: DataFrame, *columns: str) -> list[Column]:
    """All columns of df as one struct _doc, and the given ones as _c0, _c1, ...: names that operators add can't clash with df's."""
    doc = F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("_doc")
    return [doc, *(F.col(quoted(c)).alias(f"_c{k}") for k, c in enumerate(columns))]


def apart(df: DataFrame, text: str) -> list[Column]:
    """The columns of df as a struct _rest and the text as _text; whole() puts them together again."""
    return [F.struct(*(F.col(quoted(c)) for c in df.columns if c != text)).alias("_rest"), F.col(quoted(text)).alias("_text")]


def whole(columns: list[str], text: str) -> list[Column]:
    return [(F.col("_text") if c == text else F.col(f"_rest.{quoted(c)}")).alias(c) for c in columns]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most limit bytes together, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes (kind), never across rows, and each row's first word (rows + 1 values)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    # A row's first byte has no predecessor, its last none after it.
    before, after = inside[:-2].copy(), inside[2:].copy()
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside[1:-1] & ~before)
    ends = np.flatnonzero(inside[1:-1] & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte_map: np.ndarray = ASCII_LOWER) -> np.ndarray:
    """A 64-bit hash of each span's mapped bytes: equal spans hash alike wherever they stand."""
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((byte_map[data].astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])
