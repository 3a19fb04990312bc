"""Edge rows, hot groups, grids and names of columns of the decontamination, SimHash and KD-tree operators."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionspark.llm import decontamination, kdtree, simhash, textio, tiles

WORDS = [f"w{k}" for k in range(400)]


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def _plain_hits(text, items):
    """(hit words, items) by comparing all windows."""
    w, hit, found = _words(text), set(), set()
    for item, item_text in items:
        iw = _words(item_text)
        n = min(10, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(hit), sorted(found)


@pytest.mark.parametrize("most", [1 << 16, 1 << 27])
def test_decontamination_with_hot_passages_and_full_bit_sets(spark, monkeypatch, most):
    """A set that is too small for the benchmark drops less and finds the same."""
    monkeypatch.setattr(decontamination, "MAX_BITS", most)
    monkeypatch.setattr(decontamination, "PRINT_BITS", 1 << 12 if most > 1 << 16 else 64)
    rng = random.Random(2)
    passage = " ".join(rng.choice(WORDS) for _ in range(25))
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 9, 10, 40])))) for k in range(150)] + [(900, passage), (901, "x " + passage), (902, "unique"), (903, ""), (904, None)]
    docs = [(k, " ".join([*(rng.choice(WORDS) for _ in range(rng.randrange(30))), passage.upper() if k % 3 else "", *(rng.choice(WORDS) for _ in range(5))])) for k in range(120)]
    docs += [(500, " ".join(rng.choice(WORDS) for _ in range(60_000)) + " " + passage), (501, None), (501, ""), (502, "Unique! 9"), (502, "Unique! 9"), (None, passage)]
    df = spark.createDataFrame([(*d, "a", 1, 2, "r") for d in docs], "doc_id long, text string, keys string, h int, n_words int, row_key string").repartition(3)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, h int")
    got = decontamination.decontaminate(df, bench, keys=["doc_id", "keys"])
    assert got.columns == ["doc_id", "keys", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted((repr(k), len(_words(t)), *(lambda h: (h[0], len(h[1])))(_plain_hits(t, items))) for k, t in docs)
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in got.collect()) == want


def test_shared_phrase_makes_no_pairs(spark):
    """400 documents and 300 items that share one phrase of 13 words: a row for each document and window."""
    phrase = " ".join(f"p{k}" for k in range(13))
    docs = spark.createDataFrame([(k, f"d{k} {phrase} e{k}") for k in range(400)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"i{k} x{k} {phrase} y{k}") for k in range(300)], "item_id long, text string")
    rows, hits, members = decontamination.find_overlaps(docs, bench, keys=["doc_id"])
    assert (hits.count(), rows.count()) == (1600, 400) and members.count() == 300 * 7
    got = decontamination.decontaminate(docs, bench, keys=["doc_id"]).collect()
    listed = hashlib.sha256(",".join(sorted(str(k) for k in range(300))).encode()).hexdigest()
    assert {(r.n_hit, r.n_items, r.items_sha256) for r in got} == {(13, 300, listed)}


def test_bit_set_has_all_prints(spark):
    h = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 5000)
    held = decontamination.bit_set(spark.createDataFrame([(int(x),) for x in h], "h long"))
    slot = h.view(np.uint64) >> np.uint64(64 - int(np.log2(len(held) * 8)))
    on = (held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
    assert on.all() and int(np.bitwise_count(held).sum()) == len(set(slot.tolist()))


@pytest.mark.parametrize("parts", [{3: 1}, {0: 2, 5: 1, 9: 4}, {k: 3 for k in range(10, 40)}, {32: 700}])
@pytest.mark.parametrize("radius", [1, 4])
def test_grid_has_every_pair_of_tiles_once(parts, radius):
    spans, size, n = tiles.grid(parts, radius)
    pairs = [(s, t) for s, (_, b) in enumerate(spans) for t in range(s, b + 1)]
    assert sorted(pairs) == sorted((t, s) for s, (a, _) in enumerate(spans) for t in range(a, s + 1))
    classes = [c for c in sorted(parts) for _ in range(parts[c])]
    assert size <= tiles.HELD and n == len(classes)
    supers = -(-n // size)
    met = {(a, b) for i, j in pairs for a in range(i * size, min(n, (i + 1) * size)) for b in range(max(a, j * size), min(n, (j + 1) * size))}
    assert all((a, b) in met for a in range(n) for b in range(a, n) if classes[b] - classes[a] <= radius)
    assert all(0 <= i <= j < supers for i, j in pairs)


def test_plans_of_many_values():
    """10 ** 9 different fingerprints are planned with few partitions and rows on the driver; few tiles don't make many partitions."""
    weights = [math.comb(64, c) / 2**64 for c in range(65)]
    parts = {c: -(-int(1e9 * w) // simhash.TILE) for c, w in enumerate(weights) if 1e9 * w >= 1}
    spans, size, _ = tiles.grid(parts, 4, 126)
    assert len(spans) < 3000 and tiles.partitions(spans, size, 1 << 15, 1000) <= 1 << 15
    spans, size, _ = tiles.grid({c: 1 for c in range(12, 52)}, 4)
    assert tiles.partitions(spans, size, 1 << 15, 8) == 32


def test_simhash_over_many_tiles_with_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 20)
    monkeypatch.setattr(simhash, "SUB", 4)
    monkeypatch.setattr(tiles, "SUPERS", 8)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 30]))) for _ in range(150)]
    texts += [t + " " + rng.choice(WORDS) for t in texts[:100]] + [texts[0]] * 200 + [None, "", " ".join(rng.choice(WORDS) for _ in range(50_000))]
    df = spark.createDataFrame([(k, t, 1, "l", 5, 6) for k, t in enumerate(texts)], "doc_id long, text string, fp int, label string, `key` int, class int")
    got = {r.doc_id: r for r in simhash.group_near_duplicates(df, keys=["doc_id", "key"]).collect()}
    fps = [got[k].fp & (2**64 - 1) for k in range(len(texts))]
    group = list(range(len(texts)))
    for i, a in enumerate(fps):
        for j in range(i):
            if group[i] != group[j] and (a ^ fps[j]).bit_count() <= 4:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert [got[k].component_id for k in range(len(texts))] == group


@pytest.mark.parametrize(("rows", "columns"), [(1, 1), (3, 2)])
def test_top_k_on_a_grid_with_repeated_rows(spark, monkeypatch, rows, columns):
    monkeypatch.setattr(kdtree, "SHARD", 60)
    monkeypatch.setattr(kdtree, "LEAF", 8)
    monkeypatch.setattr(kdtree, "QUERIES", 7)
    monkeypatch.setattr(kdtree, "grid", lambda *_: (rows, columns))
    rng = random.Random(5)
    data = [(k % 280, [rng.choice([-2, -1, 0, 1]) / 64 for _ in range(rng.choice([4, 4, 4, 2]))]) for k in range(400)]
    df = spark.createDataFrame([(*d, "a", "b", 1.0) for d in data], "vec_id long, embedding array<double>, dim string, `row` string, score double")
    vectors, _ = textio.save(kdtree.scaled_vectors(df))
    held = vectors.collect()
    got = {}
    for r in kdtree.top_inner_products(vectors.where("vec_id % 20 = 0"), vectors, 6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    want = {}
    for q in held:
        if q.vec_id % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q.v, c.v, strict=True)), c.vec_id, c.row) for c in held if c.row != q.row and c.dim == q.dim)[:6]
            want.setdefault(q.vec_id, []).extend((i + 1, s, v) for i, (s, v, _) in enumerate(best))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_grid_bounds_what_a_task_holds():
    for shards, blocks in ((1, 1), (5, 100), (10_000, 3), (120_000, 100_000)):
        rows, columns = kdtree.grid(shards, blocks, 32)
        assert -(-shards // rows) <= kdtree.TREES and -(-blocks // columns) <= kdtree.BLOCKS
        assert rows <= shards and columns <= blocks and rows * columns >= min(32, shards * blocks) / 2
