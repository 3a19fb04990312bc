"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly tile by tile.

Equal fingerprints are first merged, so a group of copies is one value. The distinct fingerprints are dealt by
population count into packed tiles of about TILE values. Two fingerprints within the radius have population counts that
differ by the radius at most, so only such tiles are paired, on a grid that sends a tile's bytes once to each run of tiles that it meets (tiles.py); inside a pair of tiles, values are sorted by the counts of
their four 16-bit blocks, and runs of SUB values are skipped when the bounding boxes of these counts are further apart
than the radius. The rest is numpy exclusive-or and bit counts over every pair of values. A pair of tiles gives back a
spanning star of each group it finds, not the group's pairs; the stars' components over all tiles are the groups.

Comparing all values takes time that grows with the square of the distinct fingerprints; the skips lessen the factor.

Defined cases: a null or wordless text has fingerprint zero and links as any other; fewer words than a shingle are one
shingle; a null id is passed over for the group's least id (null, if all are); repeated rows stay rows; a very long text is
hashed whole, about a million shingles at a time; an empty table gives an empty result; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textio
from .components import connected_components, merge
from .tiles import over_pairs

SHINGLE, RADIUS = 4, 4
TILE, SUB = 1 << 12, 512


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each row of a piece (uint64)."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(len(offsets) - 1):
        words = data[offsets[i] : offsets[i + 1]].tobytes().lower().split()
        if not words:
            continue
        text = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(digest(text, 42))
            counts[i] = 1
            continue
        gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
        ends = [*gaps[shingle - 1 :].tolist(), len(text)]
        hashes += [digest(text[a:b], 42) for a, b in zip(starts, ends, strict=True)]
        counts[i] = len(starts)
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        first = np.concatenate(([0], np.cumsum(counts[some])))
        h = np.array(hashes, np.uint64)
        k = 0
        while k < len(some):  # bits of about a million shingles at once, or of one row
            j = max(k + 1, int(np.searchsorted(first, first[k] + (1 << 20), "right")) - 1)
            total = np.zeros((j - k, 64), np.int64)
            for a in range(int(first[k]), int(first[j]), 1 << 18):
                b = min(a + (1 << 18), int(first[j]))
                lo, hi = int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, b, "left"))
                bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                total[lo - k : hi - k] += np.add.reduceat(bits, np.maximum(first[lo:hi] - a, 0), axis=0, dtype=np.int64)
            on = 2 * total > counts[some[k:j], None]
            out[some[k:j]] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]
            k = j
    return out


def fingerprint(docs: DataFrame, *, keys: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """keys and fp (64 bits as a long) of every row."""
    docs = docs.select(*(F.col(textio.quoted(k)) for k in keys), F.col(textio.quoted(text)).alias("_text"))
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textio.utf8(batch.column(len(keys)))
            found = [fingerprints_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle) for i, j in textio.pieces(offsets)]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(fp.view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _blocks(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit blocks of each value."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    fp = group["fp"].to_numpy(np.int64).view(np.uint64)
    return pd.DataFrame({"class": group["class"].iloc[:1], "part": group["part"].iloc[:1], "payload": [fp[np.lexsort(_blocks(fp).T)].tobytes()]})


def _boxes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(fp), SUB)
    counts = _blocks(fp)
    return np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


def stars(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) of the groups that two tiles hold together."""
    values = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    label = np.arange(len(values))
    (alo, ahi), (blo, bhi) = _boxes(a), _boxes(b)
    for i in range(len(alo)):
        gap = np.maximum(0, np.maximum(alo[i] - bhi, blo - ahi[i])).sum(axis=1)
        x = a[i * SUB : (i + 1) * SUB, None]
        for j in np.flatnonzero(gap <= radius).tolist():
            if same and j < i:
                continue
            u, v = np.nonzero(np.bitwise_count(x ^ b[None, j * SUB : (j + 1) * SUB]) <= radius)
            if len(u) > (len(x) if same and i == j else 0):
                label = merge(label, u + i * SUB, v + j * SUB + shift)
    member = np.flatnonzero(label != np.arange(len(label)))
    return values[member], values[label[member]]


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that span the groups of distinct fingerprints (column fp) within the radius of each other."""
    spark = distinct.sparkSession
    counted = distinct.select("fp", F.bit_count("fp").cast("int").alias("class"))
    sizes = dict(counted.groupBy("class").count().collect())  # at most 65 rows
    parts = {p: -(-n // TILE) for p, n in sizes.items()}
    if not parts:
        return spark.createDataFrame([], "u long, v long")
    n_parts = F.create_map(*(F.lit(x) for kv in parts.items() for x in kv))
    tiles = counted.withColumn("part", F.pmod(F.xxhash64("fp"), n_parts[F.col("class")]).cast("int"))
    tiles, _ = textio.save(tiles.groupBy("class", "part").applyInPandas(_pack, "class int, part int, payload binary"), "tiles")

    def compare(a: bytes, b: bytes, same: bool) -> Iterator[pd.DataFrame]:
        u, v = stars(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), same, radius)
        yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return over_pairs(tiles, parts, radius, compare, "u long, v long")


def group_near_duplicates(docs: DataFrame, *, keys: list[str], key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """keys, fp, label (of the group) and component_id (the group's least key) of every row."""
    spark = docs.sparkSession
    carried = docs.select(F.struct(*(F.col(textio.quoted(k)).alias(f"k{i}") for i, k in enumerate(keys))).alias("keys"), F.col(textio.quoted(key)).alias("key"), F.col(textio.quoted(text)).alias("text"))
    rows, _ = textio.save(fingerprint(carried, keys=["keys", "key"]), "fingerprints")
    distinct, distinct_path = textio.save(rows.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    labels = connected_components(near_links(distinct, radius))
    labelled = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    labelled, labelled_path = textio.save(labelled, "labelled")
    groups = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    groups, _ = textio.save(labelled.select("fp", "label").join(groups, "label"), "groups")
    textio.drop(spark, distinct_path, labelled_path)
    return rows.join(groups, "fp", "left").select(*(F.col(f"keys.k{i}").alias(k) for i, k in enumerate(keys)), "fp", "label", "component_id")


def op7_simhash_tiles(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = group_near_duplicates(docs, keys=["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
