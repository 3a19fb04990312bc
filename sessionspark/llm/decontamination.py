"""Benchmark decontamination by winnowing.

Words are runs of digits, a-z (A-Z lowered) and non-ASCII characters. An item of at least WINDOW words is
represented by the fingerprints that winnowing keeps: the least K-gram hash (the rightmost of equals) of every
W consecutive K-grams, where K + W - 1 = WINDOW, so that every shared span of WINDOW words shares a kept
fingerprint. A shorter item is one window, and its fingerprint the hash of all its words.

Documents are fingerprinted in one pass over their Arrow buffers. Most fingerprints that no item has are dropped there by
a bit set of bounded size, which Spark builds from the items' fingerprints. Each of the others is extended to the windows that
keep it, and these are joined to the items' different windows, one row for each, by fingerprint and 128 bits of hashes of the
window's words: a passage that n documents and m items share costs n + m rows for each of its windows, not n * m. Which items
a document has is then read from the items of its windows, once for all documents with the same windows.

Defined cases: a null or wordless text has no words and no hits; a null benchmark text has no windows; a null item id
is left out; equal documents and repeated ids are reported row by row; an empty benchmark leaves all clean, no documents
give no rows; a very long text is scanned whole, and only words around shared fingerprints are kept of it; where several
items hold a window, all are counted; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textio

WINDOW, K = 10, 5
W = WINDOW - K + 1
#: Bits of the set that is sent to the executors: so many for each fingerprint, and at most MAX_BITS (16 MB). A larger benchmark fills the set more, so that it drops less; results don't depend on it.
PRINT_BITS, MAX_BITS = 64, 1 << 27
_CAND = pa.struct([("h", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("pos", pa.int64()), ("kind", pa.int32())])
_CAND_TYPE = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("kind", T.IntegerType())]))
#: What tells a window: the fingerprint that it keeps, the hashes of its words, and their number if it is an item of fewer than WINDOW.
KEY = ["h", "kind", "a", "b"]


def _grams(words: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 positions are missing."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64)))
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return textio.mix(h)


def winnow(words: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of every window, and of the K-gram that winnowing keeps for it; last: for each word, the end of its document."""
    g = _grams(words, K, 0)
    n = len(g) - W + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, W):
        take = g[j : j + n] <= least
        least[take] = g[j : j + n][take]
        at[take] = j
    windows = np.flatnonzero(np.arange(n) + WINDOW <= last[:n])
    return windows, windows + at[windows]


def _windows(data: np.ndarray, offsets: np.ndarray, short: list[int], bits: np.ndarray | None, whole_items: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each row of a piece, and row, h, a, b, position and kind of its windows whose fingerprints may be an item's."""
    starts, ends, first = textio.word_spans(data, offsets, textio.WORD_BYTES)
    counts = np.diff(first)
    words = textio.span_hashes(data, starts, ends)
    last, begin = np.repeat(first[1:], counts), np.repeat(first[:-1], counts)
    found = []
    for kind in [0, *short]:
        size = kind or WINDOW
        if kind:
            h = _grams(words, kind, kind)
            at = np.flatnonzero(np.arange(len(h)) + kind <= last[: len(h)])
            if whole_items:
                at = at[(begin[at] == at) & (last[at] == at + kind)]
            h = h[at]
        else:
            at, kept = winnow(words, last)
            h = _grams(words, K, 0)[kept] if len(at) else np.zeros(0, np.uint64)
        if bits is not None and len(h):
            slot = h >> np.uint64(64 - int(np.log2(len(bits) * 8)))
            keep = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
            at, h = at[keep], h[keep]
        a, b = (_grams(words, size, salt)[at] if len(at) else h for salt in (101, 102))
        found.append((at, h, a, b, np.full(len(at), kind, np.int32)))
    at, h, a, b, kind = (np.concatenate([f[k] for f in found]) for k in range(5))
    row = np.searchsorted(first, at, "right") - 1
    order = np.argsort(row, kind="stable")
    return counts, [x[order] for x in (row, h.view(np.int64), a.view(np.int64), b.view(np.int64), at - first[row], kind)]


def _scan(df: DataFrame, text: str, keys: list[str], short: list[int], bits, whole_items: bool) -> DataFrame:
    """keys, n_words and the windows of each row whose fingerprints may be an item's."""
    schema = df.select(*keys).schema.add("n_words", "long").add("cands", _CAND_TYPE)
    column = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = None if bits is None else bits.value
        for batch in batches:
            data, offsets = textio.utf8(batch.column(column))
            for i, j in textio.pieces(offsets):
                o = offsets[i : j + 1]
                counts, (row, *fields) = _windows(data[o[0] : o[-1]], o - o[0], short, shown, whole_items)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])
                cands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, t.type) for x, t in zip(fields, _CAND, strict=True)], fields=list(_CAND)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(column)), pa.array(counts, pa.int64()), cands], names=schema.names)

    return df.select(*keys, text).mapInArrow(run, schema)


def bit_set(prints: DataFrame) -> np.ndarray:
    """Bytes of the set of the first bits of the fingerprints (column h); the driver gets its 32,768-bit pieces, MAX_BITS in all at most."""
    size = min(MAX_BITS, 1 << max(16, (PRINT_BITS * prints.count()).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - (size.bit_length() - 1)) + 1
    held = np.zeros(size // 8, np.uint8)
    pieces = prints.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    for b, m in pieces.collect():
        piece = np.frombuffer(m, np.uint8)
        held[(b - 1) * len(piece) : b * len(piece)] = piece
    return held


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, keys: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, members): rows has row_key, keys (a struct k0, k1, ...) and n_words of every document; hits has row_key, lo, hi (words) and window of each item window in it; members has window and item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(textio.quoted(item_id)).cast("string").alias("item"), F.col(textio.quoted(item_text)).alias("item_text")).where("item is not null")
    lengths = _scan(items, "item_text", ["item"], [], None, True).where(f"n_words between 1 and {WINDOW - 1}").select("n_words").distinct()
    short = sorted(r[0] for r in lengths.collect())  # at most WINDOW - 1 values
    prints = _scan(items, "item_text", ["item"], short, None, True).select("item", F.explode("cands").alias("c")).select("item", *(f"c.{k}" for k in KEY))
    prints, _ = textio.save(prints.distinct(), "prints")
    windows, _ = textio.save(prints.select(*KEY).distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    members, _ = textio.save(prints.join(windows, KEY).select("window", "item"), "members")
    bits = spark.sparkContext.broadcast(bit_set(windows.select("h").distinct()))
    kept = docs.select(F.struct(*(F.col(textio.quoted(k)).alias(f"k{i}") for i, k in enumerate(keys))).alias("keys"), F.col(textio.quoted(text)).alias("text"))
    rows, _ = textio.save(_scan(kept, "text", ["keys"], short, bits, False).withColumn("row_key", F.monotonically_increasing_id()), "rows")
    near = rows.where(F.size("cands") > 0).select("row_key", F.explode("cands").alias("c")).select("row_key", *(f"c.{k}" for k in [*KEY, "pos"]))
    # A window that very many documents have is a row here for each of them, and one row there: Spark splits such a key.
    hi = F.col("pos") + F.when(F.col("kind") > 0, F.col("kind")).otherwise(F.lit(WINDOW))
    hits = near.join(windows, KEY).select("row_key", F.col("pos").alias("lo"), hi.alias("hi"), "window")
    return rows.select("row_key", "keys", "n_words"), hits, members


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, keys: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """keys, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs."""
    rows, hits, members = find_overlaps(docs, benchmark, keys=keys, text=text, item_id=item_id, item_text=item_text)
    zero = F.lit(0).cast("long")
    covered = F.aggregate(
        "runs",
        F.struct(zero.alias("end"), zero.alias("total")),
        lambda s, x: F.struct(F.greatest(s["end"], x["hi"]).alias("end"), (s["total"] + F.greatest(zero, x["hi"] - F.greatest(s["end"], x["lo"]))).alias("total")),
        lambda s: s["total"],
    )
    # A document's windows, of which it has fewer than words.
    grouped = hits.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("runs"), F.array_sort(F.collect_set("window")).alias("windows"))
    grouped = grouped.select("row_key", covered.alias("n_hit"), "windows", F.sha2(F.array_join("windows", ",").cast("binary"), 256).alias("held"))
    grouped, _ = textio.save(grouped, "grouped")
    # The items of each different set of windows.
    sets = grouped.groupBy("held").agg(F.first("windows").alias("windows")).select("held", F.explode("windows").alias("window"))
    items = sets.join(members, "window").groupBy("held").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items, _ = textio.save(items.select("held", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("listed")), "items")
    found = grouped.select("row_key", "n_hit", "held").join(items, "held")
    n_hit = F.coalesce("n_hit", zero)
    return rows.join(found, "row_key", "left").select(
        *(F.col(f"keys.k{i}").alias(k) for i, k in enumerate(keys)), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("listed", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op1_winnowing(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items, keys=["doc_id"])


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select row_number() over () as rk, doc_id, {_WORDS} as w from documents),
b as (select item_id::varchar as item, {_WORDS} as w from benchmark where item_id is not null),
bl as (select item, w, least(10, len(w)) as n from b where len(w) > 0),
bw as (select distinct item, n, array_to_string(w[i + 1 : i + n], ' ') as g from (select item, w, n, unnest(range(0, len(w) - n + 1)) as i from bl)),
dw as (select rk, i, n, array_to_string(w[i + 1 : i + n], ' ') as g from (select rk, w, n, unnest(range(0, len(w) - n + 1)) as i from d, (select distinct n from bw) where len(w) >= n)),
hit as (select distinct rk, i, n, item from dw join bw using (n, g)),
pos as (select rk, count(distinct p) as n_hit from (select rk, unnest(range(i, i + n)) as p from hit) group by rk),
its as (select rk, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct rk, item from hit) group by rk)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (rk) left join its using (rk)
"""
