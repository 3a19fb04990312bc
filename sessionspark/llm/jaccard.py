"""Near copies by the Jaccard similarity of distinct word shingles: SimHash tiles find candidates, exact sets decide.

Rows with equal shingle sets are first merged into one node. A node has 256 sketch bits (four SimHash words over its
distinct shingles). Sets with a similarity of `least` or more have sizes at most 1 / least apart, so nodes are dealt into
tiles by the logarithm of their sizes and only tiles of the same or the next class are paired. In a pair of tiles all
values are compared: the first word within RADIUS, then all 256 bits within WIDE. The radii are wide, so that few pairs at the
least similarity are lost; the candidates' sets are then compared exactly, from their texts, and only true links remain.

A pair of tiles gives back a spanning forest of its candidates, nearest first, so a large group gives no square of links.
Where a link of the forest proves false and true ones don't join its ends, its candidates' groups are looked through again:
their nodes are packed into tiles with their whole sets, and every candidate pair that true links haven't joined yet is compared inside the tasks, which
give back a spanning forest of the true ones. So no pair of candidates is left undecided, and no group's pairs are written.

Comparing all values takes time that grows with the square of the nodes; the size classes lessen the factor.

Defined cases: words are split at ASCII white space and lower-cased in A-Z; fewer words than a shingle are one shingle; null and wordless texts
are one group of their own; repeated rows stay rows; a very long text is one set as any other; an empty table gives an empty
result; key columns may have any names, other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textio
from .components import connected_components
from .tiles import over_pairs

SHINGLE, LEAST = 5, 0.8
#: Bits that the first word and the whole sketch may differ by; at a similarity of 0.8 about 10 of 64 and 39 of 256 do.
RADIUS, WIDE = 20, 72
TILE, SUB, WORDS = 1 << 12, 512, 4
#: Nodes of a tile with whole sets (or so many times 256 hashes: 8 MB), and such tiles that a task holds.
SET_TILE, SETS_HELD = 1 << 12, 4
PIECE_BYTES = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(64, dtype=np.uint64) * _STEP
_NODE = np.dtype([("n", "<i8"), ("node", "<i8"), ("bits", "<u8", (WORDS,)), ("label", "<i8")])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each row's distinct shingles, and each row's first one (rows + 1 values)."""
    starts, ends, first = textio.word_spans(data, offsets, textio.NON_SPACE_BYTES)
    words = textio.span_hashes(data, starts, ends)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    length = np.minimum(shingle, n)[row]
    at = np.flatnonzero(np.arange(len(words)) + length <= first[1:][row])
    row, length = row[at], length[at]
    h = np.zeros(len(at), np.uint64)
    for k in range(shingle):
        some = length > k
        h[some] += textio.mix(words[at[some] + k] + _STEPS[k + 1])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def sketches(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each row's set, and its sketch bits [row, word]."""
    n = np.diff(first)
    node, out = np.zeros(len(n), np.uint64), np.zeros((len(n), WORDS), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        node[some] = textio.mix(np.add.reduceat(textio.mix(h ^ _STEP), first[some]) + n[some].astype(np.uint64))
        for w in range(WORDS):
            g = textio.mix(h + _STEPS[w + 11])
            total = np.zeros((len(some), 64), np.int64)
            begin = first[some]
            for a in range(0, len(g), 1 << 17):
                b = min(a + (1 << 17), len(g))
                lo, hi = int(np.searchsorted(begin, a, "right")) - 1, int(np.searchsorted(begin, b, "left"))
                bits = np.unpackbits(g[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                total[lo:hi] += np.add.reduceat(bits, np.maximum(begin[lo:hi] - a, 0), axis=0, dtype=np.int64)
            out[some, w] = np.packbits(2 * total > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return node, out


def sketch(docs: DataFrame, *, keys: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """keys, text, node (hash of the set), n (its size) and bits of every row."""
    schema = docs.select(*keys, text).schema.add("node", "long").add("n", "long").add("bits", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textio.utf8(batch.column(len(keys)))
            for i, j in textio.pieces(offsets, PIECE_BYTES):
                h, first = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                node, bits = sketches(h, first)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array(node.view(np.int64)), pa.array(np.diff(first), pa.int64()), pa.array([b.tobytes() for b in bits], pa.binary())], names=schema.names)

    return docs.select(*keys, text).mapInArrow(run, schema)


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(len(group), _NODE)
    out["n"], out["node"], out["label"] = group["n"], group["node"], group["label"]
    out["bits"] = np.frombuffer(b"".join(group["bits"]), "<u8").reshape(-1, WORDS)
    return pd.DataFrame({"class": group["class"].iloc[:1], "part": group["part"].iloc[:1], "payload": [out[np.lexsort((out["node"], out["n"]))].tobytes()]})


def _forest(label: np.ndarray, u: np.ndarray, v: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels after all pairs are joined, and the pairs that join them: each group's nearest first."""
    used = []
    at = np.argsort(far, kind="stable")
    while True:
        at = at[label[u[at]] != label[v[at]]]
        if not len(at):
            return label, np.unique(np.concatenate(used)) if used else at
        a, b = label[u[at]], label[v[at]]
        best = np.full(len(label), len(at))
        np.minimum.at(best, a, np.arange(len(at)))
        np.minimum.at(best, b, np.arange(len(at)))
        pick = np.unique(best[best < len(at)])
        used.append(at[pick])
        a, b = a[pick], b[pick]
        while True:
            apart = a != b
            if not apart.any():
                break
            parent = np.arange(len(label))
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while not (parent[parent] == parent).all():
                parent = parent[parent]
            label, a, b = parent[label], parent[a], parent[b]


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and sketch distances of candidate pairs of two tiles with other labels, some at a time; b's places come after a's, if it is another tile."""
    shift = 0 if same else len(a)
    for i in range(0, len(a), SUB):
        x = a[i : i + SUB]
        for j in range(i if same else 0, len(b), SUB):
            y = b[j : j + SUB]
            if least * y["n"][0] > x["n"][-1] or least * x["n"][0] > y["n"][-1]:
                continue
            u, v = np.nonzero(np.bitwise_count(x["bits"][:, None, 0] ^ y["bits"][None, :, 0]) <= RADIUS)
            held = (x["label"][u] != y["label"][v]) & (np.minimum(x["n"][u], y["n"][v]) >= least * np.maximum(x["n"][u], y["n"][v]))
            if same and i == j:
                held &= u < v
            u, v = u[held], v[held]
            far = np.bitwise_count(x["bits"][u] ^ y["bits"][v]).sum(axis=1, dtype=np.int64)
            near = far <= WIDE
            if near.any():
                yield u[near] + i, v[near] + j + shift, far[near]


def forest_of_candidates(a: np.ndarray, b: np.ndarray, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of a spanning forest of two tiles' candidate pairs."""
    ids = a["node"] if same else np.concatenate([a["node"], b["node"]])
    label = np.arange(len(ids))
    for u, v, far in near_pairs(a, b, same, least):
        label, used = _forest(label, u, v, far)
        yield ids[u[used]], ids[v[used]]


def _packed_sets(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["n", "node"])
    nodes = np.frombuffer(_pack(group)["payload"].iloc[0], _NODE)
    return pd.DataFrame({"class": group["class"].iloc[:1], "part": group["part"].iloc[:1], "payload": [len(nodes).to_bytes(8, "little") + nodes.tobytes() + b"".join(group["hashes"])]})


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(payload[:8], "little")
    nodes = np.frombuffer(payload, _NODE, n, 8)
    return nodes, np.frombuffer(payload, np.uint64, offset=8 + nodes.nbytes)


def shared(h: np.ndarray, first: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many hashes the sets u and v share, for each pair. Sets are h[first[k] : first[k + 1]], sorted."""
    out = np.zeros(len(u), np.int64)
    order = np.argsort(u, kind="stable")
    n = np.diff(first)
    k = 0
    while k < len(order):
        x = u[order[k]]
        same = int(np.searchsorted(u[order], x, "right"))
        total = np.cumsum(n[v[order[k:same]]])
        j = k + max(1, int(np.searchsorted(total, 1 << 20, "right")))  # about a million hashes at once
        j = min(j, same)
        others = v[order[k:j]]
        ends = np.cumsum(n[others])
        y = h[np.repeat(first[others] - (ends - n[others]), n[others]) + np.arange(int(ends[-1]))]
        held = h[first[x] : first[x + 1]]
        hit = held[np.minimum(np.searchsorted(held, y), len(held) - 1)] == y
        out[order[k:j]] = np.add.reduceat(hit, ends - n[others], dtype=np.int64)
        k = j
    return out


def true_forest(a: bytes, b: bytes, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of a spanning forest of two tiles' true pairs with other labels: candidates are compared nearest first, joined ones are passed over."""
    (na, ha), (nb, hb) = _unpacked(a), _unpacked(b)
    nodes = na if same else np.concatenate([na, nb])
    h = ha if same else np.concatenate([ha, hb])
    n = nodes["n"]
    first = np.concatenate(([0], np.cumsum(n)))
    _, label = np.unique(nodes["label"], return_inverse=True)
    for u, v, far in near_pairs(na, nb, same, least):
        order = np.argsort(far, kind="stable")
        u, v, far, step = u[order], v[order], far[order], 256
        while True:
            apart = label[u] != label[v]
            u, v, far = u[apart], v[apart], far[apart]
            if not len(u):
                break
            x, y, z = u[:step], v[:step], far[:step]
            both = shared(h, first, x, y)
            true = both >= least * (n[x] + n[y] - both) - 1e-9
            if true.any():
                x, y = x[true], y[true]
                # label joins groups of nodes: the forest is one of groups
                joined, used = _forest(np.arange(int(label.max()) + 1), label[x], label[y], z[true])
                label = joined[label]
                yield nodes["node"][x[used]], nodes["node"][y[used]]
            u, v, far, step = u[step:], v[step:], far[step:], 2 * step


def _tiled(nodes: DataFrame, least: float, pack, columns: list[str], most: int) -> tuple[DataFrame, dict[int, int]]:
    """Packed tiles of nodes by classes of their sizes, and the tiles of each class. most: nodes, or hashes over 2 ** 8, of a tile."""
    classed = nodes.where("n > 0").withColumn("class", F.floor(F.log("n") / math.log(1 / least)).cast("int"))
    weight = F.greatest(F.count(F.lit(1)), F.sum("n") / 256 if "hashes" in columns else F.lit(0))
    parts = {r[0]: int(-(-r[1] // most)) for r in classed.groupBy("class").agg(weight).collect()}  # a row for each class of sizes
    if not parts:
        return nodes, parts
    n_parts = F.create_map(*(F.lit(x) for kv in parts.items() for x in kv))
    tiles = classed.withColumn("part", F.pmod(F.xxhash64("node"), n_parts[F.col("class")]).cast("int"))
    return textio.save(tiles.select("class", "part", *columns).groupBy("class", "part").applyInPandas(pack, "class int, part int, payload binary"), "tiles")[0], parts


def candidates(nodes: DataFrame, least: float) -> DataFrame:
    """A spanning forest (u, v) of the candidate pairs of nodes (columns node, n, bits, label)."""
    tiles, parts = _tiled(nodes, least, _pack, ["n", "node", "bits", "label"], TILE)
    if not parts:
        return nodes.sparkSession.createDataFrame([], "u long, v long")

    def compare(a: bytes, b: bytes, same: bool) -> Iterator[pd.DataFrame]:
        for u, v in forest_of_candidates(np.frombuffer(a, _NODE), np.frombuffer(b, _NODE), same, least):
            yield pd.DataFrame({"u": u, "v": v})

    return over_pairs(tiles, parts, 1, compare, "u long, v long", tile_bytes=_NODE.itemsize * TILE).distinct()


def true_links(nodes: DataFrame, least: float) -> DataFrame:
    """Links (u, v) of nodes (columns node, n, bits, label, hashes) that join all labels whose nodes have true candidate pairs."""
    tiles, parts = _tiled(nodes, least, _packed_sets, ["n", "node", "bits", "label", "hashes"], SET_TILE)
    if not parts:
        return nodes.sparkSession.createDataFrame([], "u long, v long")

    def compare(a: bytes, b: bytes, same: bool) -> Iterator[pd.DataFrame]:
        for u, v in true_forest(a, b, same, least):
            yield pd.DataFrame({"u": u, "v": v})

    return over_pairs(tiles, parts, 1, compare, "u long, v long", held=SETS_HELD)


def with_sets(nodes: DataFrame, shingle: int) -> DataFrame:
    """nodes (columns n, node, bits, label, text) with their sets' sorted hashes for their texts."""
    schema = "n long, node long, bits binary, label long, hashes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textio.utf8(batch.column(4))
            for i, j in textio.pieces(offsets, PIECE_BYTES):
                h, first = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                sets = pa.array([h[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:4]), sets], names=["n", "node", "bits", "label", "hashes"])

    return nodes.select("n", "node", "bits", "label", "text").mapInArrow(run, schema)


def compared(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """u, v and near (the sets' similarity is at least that) of every pair; texts has node and text."""
    sides = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = textio.utf8(batch.column(2)), textio.utf8(batch.column(3))
            for i, j in textio.pieces(oa + ob, PIECE_BYTES):
                ha, fa = shingle_sets(da[oa[i] : oa[j]], oa[i : j + 1] - oa[i], shingle)
                hb, fb = shingle_sets(db[ob[i] : ob[j]], ob[i : j + 1] - ob[i], shingle)
                both = np.array([len(np.intersect1d(ha[fa[k] : fa[k + 1]], hb[fb[k] : fb[k + 1]], assume_unique=True)) for k in range(j - i)], np.int64)
                near = both >= least * (np.diff(fa) + np.diff(fb) - both) - 1e-9
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(near)], names=["u", "v", "near"])

    return sides.select("u", "v", "a", "b").mapInArrow(run, "u long, v long, near boolean")


def contracted_links(links: DataFrame, labels: DataFrame) -> DataFrame:
    """links (u, v) between the labels (node, label) of their ends, each once and without those inside a label; a node without a label is its own."""
    out = links.select("u", "v")
    for end in ("u", "v"):
        found = labels.select(F.col("node").alias(end), F.col("label").alias("_label"))
        out = out.join(found, end, "left").withColumn(end, F.coalesce("_label", end)).drop("_label")
    return out.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def group_similar(docs: DataFrame, *, keys: list[str], text: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """keys and label (of the group) of every row: the components of the links with a similarity of least or more."""
    carried = docs.select(F.struct(*(F.col(textio.quoted(k)).alias(f"k{i}") for i, k in enumerate(keys))).alias("keys"), F.col(textio.quoted(text)).alias("text"))
    spark = docs.sparkSession
    with textio.scope(spark) as keep:
        rows, _ = textio.save(sketch(carried, keys=["keys"], text="text", shingle=shingle).withColumn("_row", F.monotonically_increasing_id()), "sketches")
        nodes, _ = textio.save(rows.groupBy("node").agg(F.min("_row").alias("_row"), F.first("n").alias("n"), F.first("bits").alias("bits")).withColumn("label", F.col("node")), "nodes")
        pairs, _ = textio.save(candidates(nodes, least), "pairs")
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        wanted, _ = textio.save(nodes.select("node", "_row").join(ends, "node", "left_semi"), "wanted")  # written, so that its size is known: a small one is broadcast
        texts, _ = textio.save(rows.select("_row", "text").join(wanted, "_row").select("node", "text"), "texts")
        judged, _ = textio.save(compared(pairs, texts, shingle, least), "judged")
        links = judged.where("near").select("u", "v")
        labels, _ = textio.save(connected_components(links), "labels")
        apart, _ = textio.save(contracted_links(judged.where("not near"), labels), "apart")
        if apart.limit(1).count():
            doubtful, _ = textio.save(connected_components(apart).select(F.col("node").alias("label")), "doubtful")
            ends = labels.unionByName(doubtful.select(F.col("label").alias("node"), "label").join(labels, "node", "left_anti"))
            again = nodes.select("node", "n", "bits").join(ends.join(doubtful, "label", "left_semi"), "node").join(texts, "node")
            more, _ = textio.save(true_links(with_sets(again, shingle), least), "links")
            above = connected_components(contracted_links(more, labels)).select(F.col("node").alias("label"), F.col("label").alias("above"))
            labels, _ = textio.save(ends.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label")), "labels")
        labelled = rows.select("keys", "node").join(labels, "node", "left").select("keys", F.coalesce("label", "node").alias("label"))
        labelled, path = textio.save(labelled, "similar")
        keep(path)
    return labelled.select(*(F.col(f"keys.k{i}").alias(k) for i, k in enumerate(keys)), "label")
