"""Exact top-k inner products by KD-trees of shards.

Vectors are dealt by hash into shards of about SHARD rows; a task builds each shard's tree: median splits on the widest
axis down to leaves of LEAF rows, every node with the tight bounding box of its rows. Queries are packed into blocks. Tasks
form a grid of groups of trees by groups of blocks; a task holds its trees and streams its blocks, and for each block walks
the trees one after the other: boxes bound the inner product (the box corner that suits the query best), subtrees that no
query can gain from are left out, and each query visits its leaves best bound first until the bound falls below its kth
score. The kth scores pass from tree to tree. The groups' best are ranked at the end, at most k rows a group for each query.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without an id, take no part; only
vectors of equal length meet; equal ids are rows of their own; ties go to the smaller id, then the earlier row; fewer
than k candidates give all; scores beyond a long raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textio

SHARD, LEAF, QUERIES = 8192, 256, 512
#: Trees that a task holds and blocks of queries that it streams, at most.
TREES, BLOCKS = 16, 256
_NONE, _LAST = -(1 << 62), np.iinfo(np.int64).max


def build_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row order, nodes [left, right, start, end] (left 0: a leaf), and the boxes' lower and upper corners."""
    order, nodes, lower, upper = np.arange(len(vectors)), [], [], []
    todo = [(0, len(vectors), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        held = vectors[order[start:end]]
        nodes.append([0, 0, start, end])
        if parent >= 0:
            nodes[parent][side] = len(nodes) - 1
        lower.append(held.min(axis=0))
        upper.append(held.max(axis=0))
        spread = upper[-1].astype(object) - lower[-1].astype(object) if held.dtype == np.int64 else upper[-1].astype(np.int64) - lower[-1]
        if end - start > LEAF and len(spread) and spread.max() > 0:
            axis, middle = int(np.argmax(spread)), (start + end) // 2
            order[start:end] = order[start:end][np.argpartition(held[:, axis], middle - start)]
            todo += [(middle, end, len(nodes) - 1, 1), (start, middle, len(nodes) - 1, 0)]
    return order, np.array(nodes, np.int64), np.array(lower), np.array(upper)


def _narrow(vectors: np.ndarray) -> np.ndarray:
    most = max(abs(int(vectors.min())), abs(int(vectors.max()))) if vectors.size else 0
    return vectors.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _shard(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["vec_id", "row"])
    vectors = _narrow(np.array(group["v"].tolist(), np.int64).reshape(len(group), -1))
    order, nodes, lower, upper = build_tree(vectors)
    ids, rows = (group[c].to_numpy(np.int64)[order] for c in ("vec_id", "row"))
    held = [x.tobytes() for x in (ids, rows, vectors[order], nodes, lower.astype(vectors.dtype), upper.astype(vectors.dtype))]
    return pd.DataFrame([[*group[["dim", "shard"]].iloc[0], vectors.dtype.str, *held]], columns=["dim", "shard", "kind", "ids", "rows", "vectors", "nodes", "lower", "upper"])


def _block(group: pd.DataFrame) -> pd.DataFrame:
    vectors = _narrow(np.array(group["v"].tolist(), np.int64).reshape(len(group), -1))
    return pd.DataFrame([[*group[["dim", "block"]].iloc[0], vectors.dtype.str, group["vec_id"].to_numpy(np.int64).tobytes(), group["row"].to_numpy(np.int64).tobytes(), vectors.tobytes()]], columns=["dim", "block", "kind", "ids", "rows", "vectors"])


def _magnitude(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.q_rows, self.q, self.k = rows, vectors.astype(np.int64), k
        self.score = np.full((len(rows), k), _NONE, np.int64)
        self.ids, self.rows = np.full((len(rows), k), _LAST, np.int64), np.full((len(rows), k), -1, np.int64)

    def visit(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Offer a leaf's candidates to the queries at."""
        own = rows[None, :] == self.q_rows[at, None]
        kth, kth_id = self.score[at, -1:], self.ids[at, -1:]
        gains = ((score > kth) | ((score == kth) & (ids[None, :] <= kth_id))) & ~own
        some = gains.any(axis=1)
        if not some.any():
            return
        at, gains = at[some], gains[some]
        columns = np.flatnonzero(gains.any(axis=0))
        gains = gains[:, columns]
        s = np.concatenate([self.score[at], np.where(gains, score[some][:, columns], _NONE)], axis=1)
        i = np.concatenate([self.ids[at], np.where(gains, ids[columns], _LAST)], axis=1)
        r = np.concatenate([self.rows[at], np.where(gains, rows[columns], -1)], axis=1)
        first = np.lexsort((np.where(r < 0, _LAST, r), i, -s))[:, : self.k]
        self.score[at], self.ids[at], self.rows[at] = (np.take_along_axis(x, first, axis=1) for x in (s, i, r))

    def search(self, ids, rows, vectors, nodes, lower, upper) -> None:
        """Best-first search of one tree."""
        dims = max(1, self.q.shape[1])
        most = _magnitude(self.q) * _magnitude(vectors) * dims
        if most >= 1 << 62:
            raise OverflowError("an inner product may not fit in 62 bits")
        kind = np.float64 if most < 1 << 53 else np.int64  # exact either way
        q, x = self.q.astype(kind), vectors.astype(kind)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        bound = np.full((len(q), len(nodes)), -np.inf if kind is np.float64 else _NONE, kind)
        level, leaves = np.array([0]), []
        while len(level):
            bound[:, level] = plus @ upper[level].T.astype(kind) + minus @ lower[level].T.astype(kind)
            level = level[(bound[:, level] >= self.score[:, -1:]).any(axis=0)]
            inner = nodes[level, 0] > 0
            leaves += level[~inner].tolist()
            level = nodes[level[inner], :2].reshape(-1)
        if not leaves:
            return
        leaves = np.array(leaves)
        bound = bound[:, leaves]
        turns = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(q))
        for turn in range(len(leaves)):
            leaf = turns[live, turn]
            keep = bound[live, leaf] >= self.score[live, -1]
            live, leaf = live[keep], leaf[keep]
            if not len(live):
                break
            for n in np.unique(leaf).tolist():
                at = live[leaf == n]
                a, b = nodes[leaves[n], 2:]
                self.visit(at, (q[at] @ x[a:b].T).astype(np.int64), ids[a:b], rows[a:b])


def grid(n_shards: int, n_blocks: int, tasks: int) -> tuple[int, int]:
    """Rows and columns of the grid of tasks: a row's task holds at most TREES trees (about 1 MB each), a column's streams at most BLOCKS blocks; at least `tasks` tasks, if there are so many pairs."""
    n_rows = min(n_shards, max(-(-n_shards // TREES), -(-tasks // n_blocks)))
    return n_rows, min(n_blocks, max(-(-n_blocks // BLOCKS), -(-tasks // n_rows)))


def top_inner_products(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates. Both tables: row, vec_id, dim, v (array<long>).

    A tree goes once to each column of the grid and a block once to each row: no join, and no payload for each pair.
    """
    spark = candidates.sparkSession
    n_shards, n_blocks = max(1, -(-candidates.count() // SHARD)), max(1, -(-queries.count() // QUERIES))
    n_rows, n_columns = grid(n_shards, n_blocks, 4 * spark.sparkContext.defaultParallelism)
    trees = candidates.withColumn("shard", F.pmod(F.xxhash64("vec_id", "row"), F.lit(n_shards)).cast("int")).groupBy("dim", "shard")
    trees, _ = textio.save(trees.applyInPandas(_shard, "dim int, shard int, kind string, ids binary, rows binary, vectors binary, nodes binary, lower binary, upper binary"), "trees")
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), F.lit(n_blocks)).cast("int")).groupBy("dim", "block")
    blocks, _ = textio.save(blocks.applyInPandas(_block, "dim int, block int, kind string, ids binary, rows binary, vectors binary"), "blocks")

    def all_of(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cells = trees.select("dim", (F.col("shard") % n_rows).alias("at"), all_of(n_columns).alias("over"), F.lit(0).alias("side"), F.col("shard").alias("number"), "kind", "ids", "rows", "vectors", "nodes", "lower", "upper")
    cells = cells.unionByName(blocks.select("dim", all_of(n_rows).alias("at"), (F.col("block") % n_columns).alias("over"), F.lit(1).alias("side"), F.col("block").alias("number"), "kind", "ids", "rows", "vectors"), allowMissingColumns=True)
    cells = cells.repartition(n_rows * n_columns, "dim", "at", "over").sortWithinPartitions("dim", "at", "over", "side", "number")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for f in frames:
            for r in f.itertuples(index=False):
                if (r.dim, r.at, r.over) != now:
                    now, held = (r.dim, r.at, r.over), []
                ids, rows = np.frombuffer(r.ids, np.int64), np.frombuffer(r.rows, np.int64)
                vectors = np.frombuffer(r.vectors, r.kind).reshape(len(ids), -1)
                if not r.side:
                    nodes = np.frombuffer(r.nodes, np.int64).reshape(-1, 4)
                    held.append((ids, rows, vectors, nodes, *(np.frombuffer(x, r.kind).reshape(len(nodes), -1) for x in (r.lower, r.upper))))
                    continue
                best = Best(rows, vectors, k)
                for tree in held:
                    best.search(*tree)
                q, c = np.nonzero(best.rows >= 0)
                yield pd.DataFrame({"query_row": best.q_rows[q], "query_id": ids[q], "row": best.rows[q, c], "vec_id": best.ids[q, c], "score": best.score[q, c]})

    each = cells.mapInPandas(run, "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled_vectors(embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """row, vec_id, dim and v: components as floor(scale * x); unusable vectors are left out."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = embeddings.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    return usable.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("vec_id"), F.size(vector).alias("dim"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def op6_kd_trees(spark, sf_dir: str) -> DataFrame:
    vectors, _ = textio.save(scaled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return top_inner_products(vectors.where("vec_id % 20 = 0"), vectors, 20)


ORACLE = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(x::double * 64)::bigint) as w from embeddings
  where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
p as (select q.r as qr, q.vec_id as query_id, c.vec_id, c.r, list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.r <> c.r and len(q.w) = len(c.w)),
o as (select *, row_number() over (partition by qr order by score desc, vec_id, r) as rank from p)
select query_id, rank::int as rank, vec_id, score from o where rank <= 20
"""
