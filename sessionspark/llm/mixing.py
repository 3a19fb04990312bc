"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents stand in the order of a hash; their words form one stream, cut into blocks of equal word counts.
Whole passes over a source (epochs) draw all its blocks, the last pass the first blocks of a permutation, so that the
drawn words miss the target by half a block at most. The block quotas of all sources are split down a binary tree over
the output shards: each node gives its left half of shards a multivariate-hypergeometric draw of its own blocks, the
right half the rest. A leaf's quotas are ranges of the permuted ranks, so the shards' blocks are disjoint within a pass.
Blocks are shuffled inside a shard by a hash (column order_key). Shards are laid out by shard and order_key; one of more
than RANGE_WORDS words is cut by ranges of order_key, so that no task holds a whole shard.

A block has BLOCK_WORDS words, fewer in a source of under LEAST_BLOCKS such blocks, and more where all sources together would
have over MOST_BLOCKS: numpy draws hypergeometric numbers from populations below 10^9. Sources are a dimension that its user
weighs one by one; their totals, one row for each of MOST_SOURCES sources at most, are planned on the driver. Everything that
grows with the documents stays in Spark: equal rows are one row with a count of copies, which stand one after the other in the
stream, and a source's stream is cut by as many bits of the hash as give buckets of about 1,024 rows, so that neither a
source with most of the rows nor a row repeated without end is a hot group.

Defined cases: a null text and a wordless one have size 0 and are never drawn; the null source is a source, the last;
equal rows are rows of their own; documents whose hashes tie stand in the order of their keys; a very long text is many
blocks; an empty table gives empty results; columns of any names are carried along.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textio
from .permute import div, permuted
from .running import before_buckets, bucket_bits, each_copy, top_bits

#: Words of a block, blocks that a small source has at least, blocks of all sources at most (about), sources at most.
BLOCK_WORDS, LEAST_BLOCKS, MOST_BLOCKS, MOST_SOURCES = 256, 512, 10**8, 10**5
MAX_EPOCHS = 3
#: Words of a shard that one task lays out, about, whatever the blocks' size.
RANGE_WORDS = 1 << 22


def word_counts(docs: DataFrame, *, keys: list[str], text: str) -> DataFrame:
    """keys and size (runs of non-white-space) of every row."""
    docs = docs.select(*keys, text)
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textio.utf8(batch.column(len(keys)))
            counts = [np.diff(textio.word_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], textio.NON_SPACE_BYTES)[2]) for i, j in textio.pieces(offsets)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def targets(sizes: list[int], weights: list[float], cap: float = MAX_EPOCHS) -> list[float]:
    """The words wanted of each source: shares of all sizes by weight, cap times a source's size at most, the excess shared again."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        share = left / sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if share * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share * weights[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
            open_.remove(i)
    return out


def split_quotas(quotas: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Block counts [shard, source] that add up to the quotas, by a tree of multivariate-hypergeometric draws."""
    out = np.zeros((n_shards, len(quotas)), np.int64)

    def split(held: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = held
            return
        middle = (lo + hi) // 2
        n_left = int(held.sum()) * (middle - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(held, n_left, method="marginals")
        split(left, lo, middle)
        split(held - left, middle, hi)

    if len(quotas):
        split(quotas, 0, n_shards)
    return out


def plan(totals: list[tuple[str | None, int]], n_shards: int, seed: int, weights: dict | None = None) -> pd.DataFrame:
    """A row for each source: totals, target, blocks and the ends of the shards' rank ranges. totals: sorted by source, null last."""
    names, sizes = [t[0] for t in totals], [int(t[1]) for t in totals]
    w = [weights[n] if weights else 1 + k % 3 for k, n in enumerate(names)]
    wanted = targets(sizes, w)
    usual = max(BLOCK_WORDS, -(-sum(sizes) // MOST_BLOCKS))
    words = [max(min(usual, -(-s // LEAST_BLOCKS)), 1) for s in sizes]
    blocks = [-(-s // b) for s, b in zip(sizes, words, strict=True)]
    epochs = [min(MAX_EPOCHS, math.floor(t / s + 1e-12)) if s else 0 for t, s in zip(wanted, sizes, strict=True)]
    rest = [min(n, max(0, round((t - e * s) / b))) for t, e, s, b, n in zip(wanted, epochs, sizes, words, blocks, strict=True)]
    quotas = np.array([e * n + r for e, n, r in zip(epochs, blocks, rest, strict=True)], np.int64)
    ends = np.cumsum(split_quotas(quotas, n_shards, seed), axis=0).T
    return pd.DataFrame({"source": names, "src": range(len(names)), "source_size": sizes, "target": wanted, "block_words": words, "n_blocks": blocks, "epochs": epochs, "rest": rest, "ends": list(ends)})


def mix(docs: DataFrame, *, keys: list[str], source: str = "source", text: str = "text", n_shards: int = 24, seed: int = 0, weights: dict | None = None, number: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, drawn). rows has a row for all rows of equal keys, source and text: row_key, keys (struct k0, k1, ...), copies, source, size (of each), source_size, target, and the least number.

    drawn has row_key, copy, epoch, shard, range, order_key, src, at (place in the source's stream), from_word and n_words of each piece of a drawn block.
    The stream's order is a hash of the keys and the text.
    """
    spark = docs.sparkSession
    named = F.struct(*(F.col(textio.quoted(k)).alias(f"k{i}") for i, k in enumerate(keys))).alias("keys")
    hashed = docs.select(named, F.col(textio.quoted(source)).cast("string").alias("_source"), (F.col(number) if number else F.lit(None).cast("long")).alias("number"), F.col(textio.quoted(text)).alias("_text"))
    hashed = hashed.withColumn("_hash", F.xxhash64("keys", F.xxhash64("_text"), F.lit(seed)))
    rows = word_counts(hashed, keys=["keys", "_source", "_hash", "number"], text="_text")
    rows = rows.groupBy("keys", "_source", "_hash", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("number").alias("number"))
    rows, _ = textio.save(rows.withColumn("row_key", F.monotonically_increasing_id()), "sizes")
    n_rows, most = rows.agg(F.count(F.lit(1)), F.max("copies")).first()
    totals = rows.groupBy("_source").agg(F.sum(F.col("size") * F.col("copies"))).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals = sorted(((r[0], r[1]) for r in totals), key=lambda t: (t[0] is None, t[0] or ""))
    planned = [(r.source, *(int(x) for x in (r.src, r.source_size)), float(r.target), *(int(x) for x in (r.block_words, r.n_blocks, r.epochs, r.rest)), [int(x) for x in r.ends]) for r in plan(totals, n_shards, seed, weights).itertuples(index=False)]
    n_ranges = max(1, -(-sum(r[8][-1] * r[4] for r in planned) // (n_shards * RANGE_WORDS)))
    sources = spark.createDataFrame(planned, "source string, src long, source_size long, target double, block_words long, n_blocks long, epochs long, rest long, ends array<long>")
    rows = rows.join(sources, F.col("_source").eqNullSafe(F.col("source")))
    some = rows.where("size > 0").withColumn("_bucket", top_bits(F.col("_hash"), bucket_bits(n_rows))).withColumn("_words", F.col("size") * F.col("copies"))
    before = before_buckets(some, ["src"], "_bucket", "_words")
    unsigned = F.col("_hash").bitwiseXOR(F.lit(-(1 << 63)))
    local = Window.partitionBy("src", "_bucket").orderBy(unsigned, "keys").rowsBetween(Window.unboundedPreceding, -1)
    lone = F.lit(0).cast("long")
    spans = some.withColumn("_start", F.coalesce(F.sum("_words").over(local), lone)).join(before, ["src", "_bucket"]).withColumn("_start", F.col("_start") + F.col("before"))
    spans = spans.select("row_key", "copies", "src", "_start", "size", "block_words", "n_blocks", "epochs", "rest", "ends")
    spans = each_copy(spans, "copies", ["row_key"], most=most or 0)
    spans = spans.withColumn("_start", F.col("_start") + F.col("copy") * F.col("size")).withColumn("_end", F.col("_start") + F.col("size"))
    size = F.col("block_words")
    blocks = spans.select("row_key", "copy", "src", "_start", "_end", "block_words", "n_blocks", "epochs", "rest", "ends", F.explode(F.sequence(div(F.col("_start"), size), div(F.col("_end") - 1, size))).alias("block"))
    last = permuted(F.col("block"), F.col("n_blocks"), F.xxhash64("src", "epochs", F.lit(seed)))
    times = blocks.withColumn("_times", F.when((F.col("rest") > 0) & (last < F.col("rest")), F.col("epochs") + 1).otherwise(F.col("epochs"))).where("_times > 0")
    drawn = times.withColumn("epoch", F.explode(F.sequence(lone, F.col("_times") - 1)))
    rank = F.col("epoch") * F.col("n_blocks") + permuted(F.col("block"), F.col("n_blocks"), F.xxhash64("src", "epoch", F.lit(seed)))
    order_key = F.xxhash64(F.lit(seed), "src", "epoch", "block")
    drawn = drawn.withColumn("rank", rank).select(
        "row_key",
        "copy",
        "epoch",
        F.get(F.transform(F.array("rank"), lambda r: F.size(F.filter("ends", lambda e: e <= r))), F.lit(0)).alias("shard"),  # the rank is computed once, not for each end
        F.shiftright((F.shiftright(order_key, 40) + (1 << 23)) * F.lit(n_ranges), 24).cast("int").alias("range"),
        order_key.alias("order_key"),
        "src",
        F.greatest("_start", F.col("block") * size).alias("at"),
        (F.greatest("_start", F.col("block") * size) - F.col("_start")).alias("from_word"),
        (F.least("_end", (F.col("block") + 1) * size) - F.greatest("_start", F.col("block") * size)).alias("n_words"),
    )
    return rows.select("row_key", "keys", "number", "copies", "source", "size", "source_size", "target"), drawn


_WORD = re.compile("[^\x20\x09-\x0d]+")


def _cut(text: str, size: int, runs: list[dict]) -> list[str]:
    """The words of each drawn run; a whole text stays as it is."""
    if any((r["from_word"], r["n_words"]) != (0, size) for r in runs):
        spans = [m.span() for m in _WORD.finditer(text)]
    return [text if r["n_words"] == size else text[spans[r["from_word"]][0] : spans[r["from_word"] + r["n_words"] - 1][1]] for r in runs]


def laid_out(drawn: DataFrame) -> DataFrame:
    """The shards, written in their shuffled order: drawn's pieces with place (0, 1, ... in the shard)."""
    order = Window.partitionBy("shard", "range").orderBy("order_key", "src", "at")
    pieces, _ = textio.save(drawn.withColumn("_place", F.row_number().over(order).cast("long") - 1), "shards")
    sizes = pieces.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = sizes.select("shard", "range", (F.sum("_n").over(Window.partitionBy("shard").orderBy("range")) - F.col("_n")).alias("_before"))
    return pieces.join(before, ["shard", "range"]).withColumn("place", F.col("_before") + F.col("_place")).drop("_before", "_place")


def mixed_documents(docs: DataFrame, *, source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mix as shards of documents with the columns of docs: a row for each piece of a drawn block, with its words.

    Partitions are shards in order (a large shard is several, by ranges of order_key), rows stand in the shard's shuffled
    order. Documents are told apart by two hashes of all their columns, so that the mix doesn't depend on how docs is stored.
    """
    columns = docs.columns
    same = [F.to_json(F.struct(textio.quoted(f.name))) if "map<" in f.dataType.simpleString() else F.col(textio.quoted(f.name)) for f in docs.schema]
    kept = docs.select(*textio.apart(docs, text), F.col(textio.quoted(source)).cast("string").alias("source"), F.xxhash64(*same).alias("g1"), F.xxhash64(F.lit(1), *same).alias("g2"), F.monotonically_increasing_id().alias("row"))
    kept, _ = textio.save(kept, "documents")
    rows, drawn = mix(kept, keys=["g1", "g2"], text="_text", number="row", **how)
    drawn, _ = textio.save(drawn, "drawn")
    last = drawn.agg(F.max("shard"), F.max("range")).first()
    n_shards, n_ranges = (0 if x is None else x + 1 for x in last)
    place = ["shard", "range", "order_key", "src", "at"]
    runs = drawn.join(rows.select("row_key", F.col("number").alias("row"), "size"), "row_key").groupBy("row", "copy", "epoch", "size").agg(F.collect_list(F.struct("from_word", "n_words", *place)).alias("runs"))
    joined = kept.join(runs.select("row", "size", "runs"), "row").select("_rest", "_text", "size", "runs")
    schema = T.StructType([*joined.schema.fields[:2], *(T.StructField(c, drawn.schema[c].dataType) for c in place)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textio.pieces(textio.utf8(batch.column(1))[1]):
                rest, texts, sizes, runs = (c.slice(i, j - i) for c in batch.columns)
                runs = runs.to_pylist()
                cut = [_cut(*x) for x in zip(texts.to_pylist(), sizes.to_pylist(), runs, strict=True)]
                row = pa.array(np.repeat(np.arange(j - i), [len(r) for r in runs]))
                places = [pa.array([r[c] for rs in runs for r in rs], pa.int32() if c in ("shard", "range") else pa.int64()) for c in place]
                yield pa.RecordBatch.from_arrays([rest.take(row), pa.array([t for c in cut for t in c], texts.type), *places], names=schema.names)

    out = joined.mapInArrow(run, schema)
    if "n_chars" in columns:
        out = out.withColumn("_rest", F.col("_rest").withField("n_chars", F.length("_text").cast(docs.schema["n_chars"].dataType)))
    dealt = out.repartitionById(max(1, n_shards * n_ranges), F.col("shard") * n_ranges + F.col("range")).sortWithinPartitions("order_key", "src", "at")
    return dealt.select(*textio.whole(columns, text))


def op3_splitting_tree(spark, sf_dir: str) -> DataFrame:
    """size, source_size, target and taken words of every document, the number of shards that hold some of them, and the shard and place there of the first."""
    rows, drawn = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), keys=["doc_id"])
    taken = laid_out(drawn).groupBy("row_key", "copy").agg(F.sum("n_words").alias("taken"), F.size(F.collect_set("shard")).alias("n_shards"), F.min(F.struct("shard", "place")).alias("first"))
    out = each_copy(rows, "copies", ["row_key"]).join(taken, ["row_key", "copy"], "left")
    return out.select(F.col("keys.k0").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("n_shards", F.lit(0)).alias("n_shards"), F.col("first.shard").alias("first_shard"), F.col("first.place").alias("first_place"))
