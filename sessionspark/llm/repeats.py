"""Substring dedup by seed and extend: every run of WINDOW words that an earlier document has goes.

Words are runs of bytes that aren't ASCII spaces. Seeds are winnowed K-gram hashes: the least (the rightmost of equals) of
every W consecutive K-grams, K + W - 1 = WINDOW, so that equal windows pick equal seeds. Only seeds that two different texts
share are grown: each of their windows, up to W - 1 words to the left and to the right of the seed, is joined to the least
document id that holds it, and neighbouring windows with one first document make up a maximal repeat. Windows rather than
pairs of documents are joined, so a passage that n documents share costs n rows, not n * n.

Seeds that no other text has are dropped by a bit set of at most MAX_BITS, which more shared seeds fill more: it changes the
rows that are shuffled and no result. Texts that are equal as a whole are never compared: all but the class's least id lose
every word. Windows are told apart by 80 bits, whole texts by 96 bits of hashes.

Defined cases: a null or wordless text has no words, nothing removed, and the hash of the empty string; texts under WINDOW
words lose nothing; rows with a null id lose nothing and take nothing from others; repeated rows, and different texts under one
id, take nothing from each other; a very long text is one row of one task and is never cut; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textio
from .decontamination import _grams, bit_set

WINDOW, K = 13, 5
W = WINDOW - K + 1
_AS_IS = np.arange(256, dtype=np.uint8)


def windows(words: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of every window, and of the seed that it picks; last: for each word, the end of its document."""
    g = _grams(words, K, 0)
    n = len(g) - W + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, at = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, W):
        take = g[j : j + n] <= least
        least[take] = g[j : j + n][take]
        at[take] = j
    p = np.flatnonzero(np.arange(n) + WINDOW <= last[:n])
    return p, p + at[p]


def _words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, first = textio.word_spans(data, offsets, textio.NON_SPACE_BYTES)
    counts = np.diff(first)
    return starts, ends, first, textio.span_hashes(data, starts, ends, _AS_IS), np.repeat(first[1:], counts)


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = textio.utf8(batch.column(column))
    for i, j in textio.pieces(offsets):
        o = offsets[i : j + 1]
        yield i, j, data[o[0] : o[-1]], o - o[0]


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - int(np.log2(len(bits) * 8)))
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in _pieces(batch, 1):
            _, _, first, words, last = _words(data, offsets)
            _, seed = windows(words, last)
            seed = np.unique(seed)
            row = np.searchsorted(first, seed, "right") - 1
            h = _grams(words, K, 0)[seed].view(np.int64) if len(seed) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).slice(i, j - i).take(pa.array(row))], names=["h", "digest"])


def _grown(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in _pieces(batch, 2):
                _, _, first, words, last = _words(data, offsets)
                at, seed = windows(words, last)
                if len(at):
                    shared = _held(bits.value, _grams(words, K, 0))
                    at = at[shared[seed]]
                h = _grams(words, WINDOW, 1)[at] if len(at) else np.zeros(0, np.uint64)
                check = _grams(words, WINDOW, 2)[at] if len(at) else h
                row = np.searchsorted(first, at, "right") - 1
                ids = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i).take(ids) for k in (0, 1)), pa.array((at - first[row]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array((check >> np.uint64(48)).astype(np.int32))],
                    names=["_id", "digest", "at", "h", "check"],
                )

    return run


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, digest and repeats (an array of lo, hi in words, and first, the least id that has the words) of every text with some; whole copies aside."""
    spark = docs.sparkSession
    text_ = F.col(textio.quoted(text))
    rows = docs.where(F.col(textio.quoted(key)).isNotNull() & text_.isNotNull()).select(F.col(textio.quoted(key)).alias("_id"), F.xxhash64(text_).alias("digest"), text_.alias("text"))
    seeds = rows.select("digest", "text").mapInArrow(_seeds, "h long, digest long")
    shared = seeds.groupBy("h").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("h")
    shared, path = textio.save(shared, "seeds")
    bits = spark.sparkContext.broadcast(bit_set(shared))
    textio.drop(spark, path)
    kind = rows.schema["_id"].dataType.simpleString()
    grown = rows.mapInArrow(_grown(bits), f"_id {kind}, digest long, at int, h long, check int")
    first = grown.groupBy("h", "check").agg(F.min("_id").alias("first"), F.max("_id").alias("_most")).where("first < _most").drop("_most")
    # Written, so that the join below may split a window that very many documents hold.
    first, _ = textio.save(first, "first")
    found = grown.join(first, ["h", "check"]).where("_id > first").select("_id", "digest", "at", "first")
    # A document's windows in order: one repeat goes on while windows are neighbours and have one first document.
    steps = found.withColumn("_run", F.col("at") - F.expr("dense_rank() over (partition by _id, digest, first order by at)"))
    runs = steps.groupBy("_id", "digest", "first", "_run").agg(F.min("at").alias("lo"), (F.max("at") + WINDOW).alias("hi"))
    return runs.groupBy("_id", "digest").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "first"))).alias("repeats"))


def _kept(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, list[str]]:
    """Words of each row, and SHA-256 of its kept ones with one space between."""
    starts, ends, first = textio.word_spans(data, offsets, textio.NON_SPACE_BYTES)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    if keep is not None:
        starts, ends, row = starts[keep], ends[keep], row[keep]
    out = np.append(data, np.uint8(32))
    more = np.append(row[1:] == row[:-1], False)[: len(row)]
    out[ends[more]] = 32
    step = np.zeros(len(data) + 3, np.int8)
    step[starts] += 1
    np.add.at(step, ends + more, -1)
    inside = np.cumsum(step[:-2], dtype=np.int8) > 0
    at = np.concatenate([[0], np.cumsum(inside)])[offsets]
    out = out[inside].tobytes()
    return counts, [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _all_words(bits):
    """Words and hash of every text; the text goes on where its key may be in the bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = _held(bits.value, np.asarray(batch.column(2)).view(np.uint64))
            for i, j, data, offsets in _pieces(batch, 3):
                counts, shas = _kept(data, offsets)
                texts = batch.column(3).take(pa.array(np.arange(i, j), mask=~held[i:j]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 1)), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), texts], names=["_id", "digest", "n_words", "sha", "text"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_removed and the kept words' hash of texts with repeats; other rows pass."""
    for batch in batches:
        for i, j, data, offsets in _pieces(batch, 4):
            _, _, first = textio.word_spans(data, offsets, textio.NON_SPACE_BYTES)
            part = batch.column(5).slice(i, j - i)
            per = np.diff(np.asarray(part.offsets)) if not part.null_count else np.array([len(x) if x.is_valid else 0 for x in part])
            flat = part.flatten()
            base = np.repeat(first[:-1], per)
            step = np.zeros(int(first[-1]) + 1, np.int64)
            np.add.at(step, base + np.asarray(flat.field("lo")), 1)
            np.add.at(step, base + np.asarray(flat.field("hi")), -1)
            gone = np.cumsum(step[:-1]) > 0
            _, shas = _kept(data, offsets, ~gone)
            removed = np.concatenate([[0], np.cumsum(gone)])[first]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 1)), batch.column(2).slice(i, j - i), pa.array(np.diff(removed), pa.int64()), pa.array(shas, pa.string())], names=["_id", "digest", "n_words", "n_removed", "sha"])


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed and kept_sha256 of every row of docs."""
    spark = docs.sparkSession
    text_, id_ = F.col(textio.quoted(text)), F.col(textio.quoted(key))
    kind = docs.select(id_).schema[0].dataType.simpleString()
    found, _ = textio.save(repeats(docs, key=key, text=text), "repeats")
    bits = spark.sparkContext.broadcast(bit_set(found.select(F.xxhash64("_id", "digest").alias("h"))))
    # Whole texts: all but the least id of a class lose every word, if there is a window in it.
    whole = docs.where(id_.isNotNull()).select(id_.alias("_id"), F.xxhash64(text_).alias("digest"), F.crc32(text_.cast("binary")).alias("crc")).where("crc is not null")
    whole = whole.groupBy("digest", "crc").agg(F.min("_id").alias("least"), F.max("_id").alias("most")).where("least < most").drop("most")
    # Written, so that the join below may split the rows of one class.
    whole, _ = textio.save(whole, "whole")
    rows = docs.select(id_.alias("_id"), F.struct(F.xxhash64(text_).alias("d"), F.crc32(text_.cast("binary")).alias("c")).alias("digest"), F.xxhash64(id_, F.xxhash64(text_)).alias("h"), text_.alias("text"))
    rows = rows.mapInArrow(_all_words(bits), f"_id {kind}, digest struct<d:long,c:long>, n_words long, sha string, text string").select("_id", F.col("digest.d").alias("digest"), F.col("digest.c").alias("crc"), "n_words", "sha", "text")
    rows = rows.join(whole, ["digest", "crc"], "left")
    copy = F.coalesce(F.col("least") < F.col("_id"), F.lit(False)) & (F.col("n_words") >= WINDOW)
    rows = rows.select("_id", "digest", "n_words", "sha", F.when(~copy, F.col("text")).alias("text"), copy.alias("copy"))
    rows = rows.join(found, ["_id", "digest"], "left")
    some = F.col("repeats").isNotNull() & F.col("text").isNotNull()
    cut = rows.where(some).select("_id", "digest", "n_words", "sha", "text", "repeats").mapInArrow(_cut, f"_id {kind}, digest long, n_words long, n_removed long, sha string")
    rest = rows.where(~some).select("_id", "digest", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("sha"))
    return cut.unionByName(rest).select(F.col("_id").alias(key), "n_words", "n_removed", F.col("sha").alias("kept_sha256"))


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE = f"""
with d as (select row_number() over () as rk, doc_id, {_WORDS} as w from documents),
g as (select rk, doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') as g from (select rk, doc_id, w, unnest(range(0, len(w) - 12)) as i from d where len(w) >= 13)),
f as (select g, min(doc_id) as first from g group by g),
p as (select rk, list_distinct(flatten(list(range(i, i + 13)))) as gone from g join f using (g) where doc_id > first group by rk),
r as (select d.rk, doc_id, w, coalesce(gone, []) as gone from d left join p using (rk))
select doc_id, len(w)::bigint as n_words, len(gone)::bigint as n_removed, sha256(array_to_string(list_filter(w, lambda x, k: not list_contains(gone, k - 1)), ' ')) as kept_sha256 from r
"""
