"""Sharding by a Feistel permutation over global row numbers, with DataFrame functions only.

A row's global number is its place in the order of (hash of id, size and crc of the text). The hash's first bits, as many as
give buckets of about BUCKET_ROWS rows, deal the rows into ranges of equal expected size whatever the ids are; the rows
before a bucket are a running sum in two levels. The permuted number p gives shard p mod n_shards and slot p div
n_shards: shard counts are at most one apart (law `rows`), and the place of any row number can be computed without the table.

Defined cases: a null text has no bytes (size 8, crc 0); a very long one is one row as any other; repeated rows have numbers
of their own (they are counted before the shuffle, and rows with very many copies are dealt out again before they are
written, so that a row repeated without end is no hot group); rows that tie in hash are ordered by id, size and crc; null
ids are allowed; an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textio
from .permute import div, permuted
from .running import before_buckets, bucket_bits, each_copy, top_bits


def shard_by_row_number(docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row."""
    n_rows = docs.count()
    text_ = F.col(textio.quoted(text))
    size = F.coalesce(F.octet_length(text_), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(text_, F.lit("")).cast("binary"))
    rows = docs.select(F.col(textio.quoted(key)).alias("_key"), size.alias("_size"), crc.alias("_crc")).groupBy("_key", "_size", "_crc").agg(F.count(F.lit(1)).alias("_copies"))
    rows = rows.withColumn("_hash", F.xxhash64("_key", "_size", "_crc")).withColumn("_bucket", top_bits(F.col("_hash"), bucket_bits(n_rows)))
    before = before_buckets(rows, [], "_bucket", "_copies")
    unsigned = F.col("_hash").bitwiseXOR(F.lit(-(1 << 63)))
    local = Window.partitionBy("_bucket").orderBy(unsigned, "_key", "_size", "_crc").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("_copies").over(local), F.lit(0).cast("long"))).join(before, "_bucket")
    rows = each_copy(rows, "_copies", ["_hash"])
    number = F.col("before") + F.col("_start") + F.col("copy")
    placed = rows.select("_key", "_size", "_crc", permuted(number, F.lit(n_rows).cast("long"), F.lit(seed)).alias("_p"))
    n = F.lit(n_shards).cast("long")
    return placed.select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        (F.col("_p") % n).cast("int").alias("shard"),
        div(F.col("_p"), n).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_feistel_shards(spark, sf_dir: str) -> DataFrame:
    return shard_by_row_number(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
