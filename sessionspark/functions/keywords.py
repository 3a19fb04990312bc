"""Keywords of a table, of any number, found anywhere in texts by an automaton over Arrow columns.

The texts are read once, whatever the number of keywords. Keywords of up to BUNDLE_BYTES make one automaton, which goes with the
function to the workers and leaves the texts where they are. More are dealt into bundles of that size; each bundle meets all
texts, in slices that are tasks of their own, and no task holds more than one bundle's automaton.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stored import stored

#: Bytes of the keywords and names of one automaton.
BUNDLE_BYTES = 2 << 20
#: Keywords of so many characters are sought one by one: they are few, and match too often for the automaton.
SHORT = 2


class Matcher:
    """Names of the keywords that a text contains, from (keyword, name) pairs."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        names: dict[str, set[str]] = {}
        for keyword, name in pairs:
            names.setdefault(keyword, set()).add(name)
        self.short = {k: v for k, v in names.items() if len(k) <= SHORT}
        self.long = ahocorasick.Automaton()
        for k, v in names.items():
            if len(k) > SHORT:
                self.long.add_word(k, tuple(v))
        self.long.make_automaton()
        self.some = len(self.long) > 0

    def __call__(self, text: str) -> list[str]:
        found = {v for k, v in ((k, n) for k, names in self.short.items() if k in text for n in names)}
        if self.some:
            for names in {v for _, v in self.long.iter(text)}:
                found.update(names)
        return sorted(found)


_STRINGS = T.ArrayType(T.StringType())


def matching(pairs: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """A function of a text column that gives the sorted names of its keywords; null of a null text."""
    held: list[Matcher] = []

    def found(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Matcher(pairs))
        return pa.array([None if t is None else held[0](t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(found, _STRINGS)


def with_matches(texts: DataFrame, text: Column, keywords: DataFrame, out: str, *, bundle_bytes: int | None = None) -> DataFrame:
    """texts and the sorted different names of the keywords (keyword, name; nulls are passed over) that each text contains; null of a null text."""
    limit = BUNDLE_BYTES if bundle_bytes is None else bundle_bytes
    words = keywords.where("keyword is not null and name is not null").select("keyword", "name").distinct()
    size = words.agg(F.sum(F.octet_length("keyword") + F.octet_length("name"))).first()[0] or 0
    if size <= limit:
        return texts.withColumn(out, matching([tuple(r) for r in words.collect()])(text))
    return _by_bundles(texts, text, words, out, -(-size // limit))


def _by_bundles(texts: DataFrame, text: Column, words: DataFrame, out: str, n_bundles: int) -> DataFrame:
    spark = texts.sparkSession
    held = stored(texts.withColumn("_text", text).withColumn("_row", F.monotonically_increasing_id()), "texts")
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // n_bundles)
    every = F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle")
    some = held.where("_text is not null").select(every, F.pmod(F.xxhash64("_row"), F.lit(slices)).alias("slice"), F.lit(1).alias("kind"), F.col("_row").alias("row"), F.col("_text").alias("text"), F.lit(None).cast("string").alias("name"))
    dealt = words.select(F.pmod(F.xxhash64("keyword"), F.lit(n_bundles)).cast("int").alias("bundle"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), F.col("keyword").alias("text"), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, matcher = None, [], None
        for batch in batches:
            rows, names = [], []
            for bundle, slice_, kind, row, t, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bundle, slice_) != now:
                    now, pairs, matcher = (bundle, slice_), [], None
                if kind == 0:
                    pairs.append((t, name))
                    continue
                if matcher is None:
                    matcher, pairs = Matcher(pairs), []
                if found := matcher(t):
                    rows.append(row)
                    names.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(names, pa.list_(pa.string()))], names=["row", "names"])

    met = dealt.unionByName(some).repartition("bundle", "slice").sortWithinPartitions("bundle", "slice", "kind").mapInArrow(run, "row long, names array<string>")
    grouped = met.groupBy(F.col("row").alias("_found")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias(out))
    none = F.when(F.col("_text").isNotNull(), F.array().cast(_STRINGS))
    return held.join(grouped, F.col("_row") == F.col("_found"), "left").select(*texts.columns, F.coalesce(out, none).alias(out))
