"""Running sums and copies of rows with DataFrame functions only, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket holds, about; buckets whose sums one window takes; copies that one row stands for at first.
BUCKET_ROWS, LOW_BITS, CHUNK = 1024, 12, 4096


def bucket_bits(n_rows: int) -> int:
    """Bits of a hash that deal so many rows into buckets of about BUCKET_ROWS."""
    return (n_rows // BUCKET_ROWS).bit_length()


def top_bits(h: Column, bits: int) -> Column:
    """The first bits of a 64-bit hash: a bucket that rises with the hash as an unsigned number."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def before_buckets(rows: DataFrame, by: list[str], bucket: str, value: str) -> DataFrame:
    """by, bucket and before: the sum of value in the lower buckets of the group by.

    Sums of buckets are run in two levels, so a window takes 2 ** LOW_BITS buckets, or one row for so many of them. by and bucket hold no nulls.
    """
    per = rows.groupBy(*by, bucket).agg(F.sum(value).alias("_n")).withColumn("_high", F.shiftright(bucket, LOW_BITS))
    high = per.groupBy(*by, "_high").agg(F.sum("_n").alias("_m"))
    high = high.select(*by, "_high", (F.sum("_m").over(Window.partitionBy(*by).orderBy("_high")) - F.col("_m")).alias("_base"))
    within = F.sum("_n").over(Window.partitionBy(*by, "_high").orderBy(bucket)) - F.col("_n")
    return per.withColumn("_within", within).join(high, [*by, "_high"]).select(*by, bucket, (F.col("_base") + F.col("_within")).alias("before"))


def each_copy(rows: DataFrame, n: str, spread: list[str], most: int | None = None) -> DataFrame:
    """A row for each of a row's n copies (0 gives none), with copy 0 .. n - 1.

    Rows with more than CHUNK copies are dealt out by spread, so that no task writes them all; where most, the greatest n, is known to be no more, there are none.
    """
    zero = F.lit(0).cast("long")
    few = rows.where(F.col(n).between(1, CHUNK)).withColumn("copy", F.explode(F.sequence(zero, F.col(n) - 1)))
    if most is not None and most <= CHUNK:
        return few
    many = rows.where(F.col(n) > CHUNK).withColumn("_chunk", F.explode(F.sequence(zero, F.call_function("div", F.col(n) - 1, F.lit(CHUNK).cast("long"))))).repartition(*spread, "_chunk")
    many = many.withColumn("copy", F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least((F.col("_chunk") + 1) * CHUNK, F.col(n)) - 1))).drop("_chunk")
    return few.unionByName(many)
