"""SHA-256 of a group's joined values, for groups of any size.

SHA-256 reads its input in order, so one group's bytes pass through one task in the end; here they pass as pieces, and no more
than one piece is held. Groups that lie whole in a sorted range are hashed where they are, so that only those cut by a range's
border, or longer than PIECE values, are dealt out again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textio

#: Values of a piece.
PIECE = 4096


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def hash_pieces(pieces: DataFrame, keys: list[str], separator: str) -> DataFrame:
    """keys and sha256 of pieces (keys, n, whole, piece; written before), a group's in the order of n with the separator between. whole: it is the group's only one."""
    whole = pieces.where("whole").select(*keys, F.sha2(F.col("piece").cast("binary"), 256).alias("sha256"))
    width, between = len(keys), separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kinds = None, None, []
        for batch in batches:
            kinds, out = [*(f.type for f in batch.schema)][:width] + [pa.string()], []
            for *key, piece in zip(*(batch.column(k).to_pylist() for k in range(width)), batch.column(width), strict=True):
                if key != now:
                    if state is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(between)
                state.update(piece.as_py().encode())
            yield _batch(out, kinds, [*keys, "sha256"])
        if state is not None:
            yield _batch([(*now, state.hexdigest())], kinds, [*keys, "sha256"])

    cut = pieces.where("not whole").repartition(*keys).sortWithinPartitions(*keys, "n").select(*keys, "piece").mapInArrow(run, whole.schema)
    return whole.unionByName(cut)


def sha256_joined(rows: DataFrame, keys: list[str], order: list[str], value: str, separator: str) -> DataFrame:
    """keys and sha256 of each group's values (strings, none null) in order, joined by the separator."""
    names = [*keys, "n", "whole", "piece"]
    schema = rows.select(*keys).schema.add("n", "long").add("whole", "boolean").add("piece", "string")
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, made, kinds = TaskContext.get().partitionId() << 33, 0, []
        now, held, inside = None, [], False  # inside: the group began in this range, and no piece of it has gone yet
        for batch in batches:
            kinds, out = [*(f.type for f in batch.schema)][:width] + [pa.int64(), pa.bool_(), pa.string()], []
            for *key, v in zip(*(batch.column(k).to_pylist() for k in range(width + 1)), strict=True):
                if now is not None and (key != now or len(held) == PIECE):
                    out.append((*now, place + made, inside and key != now, separator.join(held)))
                    made, held, inside = made + 1, [], key != now
                now = key
                held.append(v)
            yield _batch(out, kinds, names)
        if now is not None:
            yield _batch([(*now, place + made, False, separator.join(held))], kinds, names)

    sorted_ = rows.select(*keys, *order, value).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*keys, value)
    pieces, _ = textio.save(sorted_.mapInArrow(run, schema), "pieces")
    return hash_pieces(pieces, keys, separator)
