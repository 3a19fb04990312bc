"""Mixing and sharding against plain Python: the drawn words, the law of the tree, the shards' local shuffle, the Feistel places."""

import math
import uuid
import zlib
from collections import Counter
from pathlib import Path
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionspark.llm import mixing, running, sharding, textio

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rows = [(k, " ".join(f"w{k}_{i}" for i in range(5 + k % 40)), "en", f"s{k % 3}" if k % 7 else None, 0) for k in range(300)]
    return [*rows, *[rows[11]] * 9, (None, "no id here", "en", "s1", 1), (400, None, None, "s2", 2), (401, " \n", None, "s3", 3), (402, "long " * 30_000, "en", "é", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


def _plain_taken(rows, seed=0):
    """Words taken of each (doc_id, text, source) row, all copies together."""
    distinct, copies = sorted({(k, t, s) for k, t, _, s, _ in rows}, key=repr), Counter((k, t, s) for k, t, _, s, _ in rows)
    size = {r: len((r[1] or "").split()) for r in distinct}
    totals = Counter()
    for r in distinct:
        totals[r[2]] += size[r] * copies[r]
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    plan = mixing.plan([(s, totals[s]) for s in names], 24, seed)
    taken = Counter()
    for src, (name, p) in enumerate(zip(names, plan.itertuples(), strict=True)):
        held = [r for r in distinct if r[2] == name and size[r]]
        held.sort(key=lambda r: (plain.spark_hash(("l", r[0]), ("l", plain.spark_hash(("s", r[1]))), ("i", seed)) % 2**64))
        words = [r for r in held for _ in range(size[r] * copies[r])]
        for block in range(int(p.n_blocks)):
            times = int(p.epochs) + (p.rest > 0 and plain.permuted(block, int(p.n_blocks), ("l", plain.spark_hash(("l", src), ("l", int(p.epochs)), ("i", seed)))) < p.rest)
            for r in words[block * int(p.block_words) : (block + 1) * int(p.block_words)]:
                taken[r] += times
    return taken


def test_taken_words_equal_the_plain_mix(spark, docs, monkeypatch):
    monkeypatch.setattr(running, "BUCKET_ROWS", 8)
    monkeypatch.setattr(running, "LOW_BITS", 2)
    monkeypatch.setattr(running, "CHUNK", 4)
    rows, drawn = mixing.mix(docs, keys=["doc_id"])
    key = {r.row_key: (r["keys"].k0, r.source) for r in rows.collect()}
    got, want = Counter(), Counter()
    for r in drawn.collect():
        got[key[r.row_key]] += r.n_words
    for (k, _, s), n in _plain_taken(_rows()).items():
        want[(k, s)] += n
    assert +got == +want


def test_targets_are_met_and_no_document_is_taken_too_often(spark, docs):
    folder = f"{textio.shared_folder(spark)}/mixed-{uuid.uuid4().hex}"
    docs.write.parquet(f"{folder}/documents.parquet")
    got = mixing.op3_splitting_tree(spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.op3_splitting_tree(spark, folder).collect()), key=repr)
    assert len(got) == len(_rows()) and all(r.taken <= 3 * r["size"] for r in got)
    for target in {r.target for r in got}:
        assert abs(sum(r.taken for r in got if r.target == target) - target) <= max(2, 0.01 * target)
    assert all((r.n_shards > 0) == (r.taken > 0) == (r.first_shard is not None) for r in got)


def test_leaves_add_up_and_follow_the_hypergeometric_law():
    quotas = np.array([10, 3, 0, 7])
    for seed in range(50):
        out = mixing.split_quotas(quotas, 5, seed)
        assert (out.sum(axis=0) == quotas).all() and (out >= 0).all() and out.sum(axis=1).tolist() == [4] * 5
    n = 6000
    seen = Counter(tuple(mixing.split_quotas(np.array([4, 3, 2]), 3, seed)[0]) for seed in range(n))
    chance = {(a, b, 3 - a - b): math.comb(4, a) * math.comb(3, b) * math.comb(2, 3 - a - b) / math.comb(9, 3) for a in range(4) for b in range(4) if 0 <= 3 - a - b <= 2}
    assert set(seen) <= set(chance)
    assert sum((seen[k] - n * p) ** 2 / (n * p) for k, p in chance.items()) < 30  # eight degrees of freedom
    both = Counter(tuple(mixing.split_quotas(np.array([4, 4]), 4, seed)[:, 0]) for seed in range(n))
    assert all(abs(both[k] / n - math.comb(2, k[0]) * math.comb(2, k[1]) * math.comb(2, k[2]) * math.comb(2, k[3]) / math.comb(8, 4)) < 0.03 for k in both)


def test_block_sizes_grow_smoothly():
    for scale in (1, 10**4, 10**8, 10**13):
        p = mixing.plan([("a", 3 * scale), ("b", 5 * scale), (None, scale)], 24, 0)
        assert p.n_blocks.sum() <= 1.01 * mixing.MOST_BLOCKS + 3 * mixing.LEAST_BLOCKS
    words = [mixing.plan([("a", n)], 2, 0).block_words[0] for n in (100, 10_000, 10**6, 10**9, 10**11, 10**12)]
    assert words == sorted(words) and words[2:4] == [256, 256]


@pytest.mark.parametrize("range_words", [1 << 22, 200])
def test_shards_hold_their_quotas_in_shuffled_order(spark, docs, monkeypatch, range_words):
    monkeypatch.setattr(mixing, "RANGE_WORDS", range_words)
    rows, drawn = mixing.mix(docs, keys=["doc_id"], n_shards=5)
    pieces = mixing.laid_out(drawn).collect()
    totals = sorted(((r[0], r[1]) for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies"))).collect()), key=lambda t: (t[0] is None, t[0] or ""))
    plan = mixing.plan(totals, 5, 0)
    want = mixing.split_quotas((plan.epochs * plan.n_blocks + plan.rest).to_numpy(np.int64), 5, 0)
    got = np.zeros_like(want)
    blocks = {(r.shard, r.src, r.order_key) for r in pieces}
    assert len({(src, key) for _, src, key in blocks}) == len(blocks)  # the leaves are disjoint
    for shard, src, _ in blocks:
        got[shard, src] += 1
    assert (got == want).all() and got.sum() > 0
    for shard in range(5):
        held = sorted((r for r in pieces if r.shard == shard), key=lambda r: r.place)
        assert [r.place for r in held] == list(range(len(held)))
        assert [(r.order_key, r.src, r.at) for r in held] == sorted((r.order_key, r.src, r.at) for r in held)
    assert (max(r.range for r in pieces) > 0) == (range_words == 200)


def test_mixed_documents_are_written_in_the_shards_order(spark, docs):
    clash = docs.withColumns({"_row": F.lit("r"), "copies": F.lit(1), "my col": F.lit("m"), "shard": F.lit("x"), "m": F.create_map(F.lit("k"), F.col("doc_id"))})
    mixed = mixing.mixed_documents(clash, n_shards=5)
    assert mixed.columns == clash.columns
    rows = mixed.withColumn("part", F.spark_partition_id()).collect()
    words = {}
    for r in docs.collect():
        words.setdefault(r.doc_id, set()).update((r.text or "").split())
    assert len({r.part for r in rows}) == 5
    assert all(set(r.text.split()) <= words[r.doc_id] and r.n_chars == len(r.text) and (r["my col"], r._row) == ("m", "r") for r in rows)
    table, drawn = mixing.mix(docs.withColumn("m", F.lit(1)), keys=["doc_id"], n_shards=5)
    assert abs(sum(len(r.text.split()) for r in rows) - drawn.agg(F.sum("n_words")).first()[0]) <= 5 * 256  # hashes of other columns, other blocks
    by_shard = [[r.doc_id for r in rows if r.part == p] for p in range(5)]
    assert all(ids != sorted(ids, key=lambda k: k or 0) for ids in by_shard)


@pytest.mark.parametrize("n_shards", [1, 7])
def test_sharding_equals_the_plain_permutation(spark, monkeypatch, n_shards):
    monkeypatch.setattr(running, "BUCKET_ROWS", 8)
    monkeypatch.setattr(running, "LOW_BITS", 2)
    monkeypatch.setattr(running, "CHUNK", 4)
    rows = [(k, t) for k, t, _, _, _ in _rows()]
    facts = [(k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in rows]
    order = sorted(facts, key=lambda f: plain.spark_hash(("l", f[0]), ("l", f[1]), ("l", f[2])) % 2**64)
    want = []
    for number, f in enumerate(order):
        p = plain.permuted(number, len(rows), ("i", 0))
        want.append((*f, p % n_shards, p // n_shards))
    docs = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, _hash string, `copy` string, before int").repartition(3)
    got = sharding.shard_by_row_number(docs, n_shards).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=repr) == sorted(want, key=repr)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    for s in range(n_shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(len(rows) // n_shards + (s < len(rows) % n_shards)))
