"""Pairs of tiles on a grid: every tile goes once to each pair of super-tiles that it belongs to, and pairs of tiles are formed inside the tasks.

Tiles have a class (a small number, as a population count) and are compared if their classes are at most `radius` apart.
They are numbered by class; runs of neighbouring tiles make super-tiles. A task holds the tiles of one super-tile and
streams those of the other, so a tile's bytes are written once for each super-tile it meets, not for each tile. There are
about as many super-tiles as give each core several pairs, and more where a task would hold too many tiles.

The driver plans the least and greatest super-tile that each super-tile meets, a row for each; the pairs themselves come from
Spark, and many go to one partition: as many as make PARTITION_BYTES, in MOST_PARTITIONS at most.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Super-tiles at least (if there are so many tiles), and tiles that a task holds at most.
SUPERS, HELD = 32, 128
PARTITION_BYTES, MOST_PARTITIONS = 1 << 26, 1 << 15


def grid(parts: dict[int, int], radius: int, supers: int = SUPERS, held: int = HELD) -> tuple[list[tuple[int, int]], int, int]:
    """(the least and the greatest super-tile that each one meets, itself included; tiles of a super-tile; the number of tiles). parts: tiles of each class."""
    n = sum(parts.values())
    size = min(held, max(1, n // supers))
    low, high, begin = [], [], 0  # least and greatest class of each super-tile
    for c in sorted(parts):
        for s in range(begin // size, (begin + parts[c] - 1) // size + 1):
            if s == len(low):
                low.append(c)
                high.append(c)
            high[s] = c
        begin += parts[c]
    return [(bisect_left(high, low[s] - radius), bisect_right(low, high[s] + radius) - 1) for s in range(len(low))], size, n


def partitions(spans: list[tuple[int, int]], size: int, tile_bytes: int, cores: int) -> int:
    """Partitions for the pairs of super-tiles."""
    pairs = sum(b - s + 1 for s, (_, b) in enumerate(spans))
    return max(1, min(pairs, MOST_PARTITIONS, max(4 * cores, -(-pairs * 2 * size * tile_bytes // PARTITION_BYTES))))


def over_pairs(tiles: DataFrame, parts: dict[int, int], radius: int, compare: Callable, schema: str, held: int = HELD, tile_bytes: int = 1 << 15) -> DataFrame:
    """The frames (of the schema) that compare(payload, payload, same) gives for all pairs of tiles (class, part, payload) whose classes are at most radius apart.

    The driver plans with the numbers of tiles only.
    """
    spark, cores = tiles.sparkSession, tiles.sparkSession.sparkContext.defaultParallelism
    spans, size, _ = grid(parts, radius, max(SUPERS, math.isqrt(16 * cores)), held)
    begins, n = {}, 0
    for c in sorted(parts):
        begins[c], n = n, n + parts[c]
    plan = spark.createDataFrame([(s, a, b) for s, (a, b) in enumerate(spans)], "super long, low long, high long")
    first = F.create_map(*(F.lit(x) for kv in begins.items() for x in kv))[F.col("class")]
    # A tile is held for the pairs with its own super-tile and later ones, and streamed for those with earlier ones.
    other = F.explode(F.sequence("low", "high")).alias("other")
    dealt = tiles.withColumn("super", F.floor((first + F.col("part")) / size).cast("long")).join(plan, "super").select("super", "class", "payload", other)
    dealt = dealt.select(F.least("super", "other").alias("a"), F.greatest("super", "other").alias("b"), (F.col("super") > F.col("other")).alias("later"), "class", "payload")
    dealt = dealt.repartition(partitions(spans, size, tile_bytes, cores), "a", "b").sortWithinPartitions("a", "b", "later")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for f in frames:
            for a, b, later, kind, payload in f.itertuples(index=False, name=None):
                if (a, b) != now:
                    now, kept = (a, b), []
                for other_kind, other in kept if later or a == b else []:
                    if abs(other_kind - kind) <= radius:
                        yield from compare(other, payload, False)
                if not later:
                    kept.append((kind, payload))
                    if a == b:
                        yield from compare(payload, payload, True)

    return dealt.mapInPandas(run, schema)
