"""op12 against tries built from the plain sequences."""

import hashlib
import random
import zlib

import pytest

from sessionspark.llm import digests, trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def _plain(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        ends.setdefault(turns, []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)
    out = []
    for s, convs in members.items():
        below, todo = [], [s]
        while todo:
            below.append(todo.pop())
            todo += children.get(below[-1], [])
        listed = ",".join(map(str, sorted(ends.get(s, []))))
        saved = sum((len(members[b]) - 1) * len(b[-1][1]) for b in below if b)
        out.append((min(convs), len(s), min(members[s[:-1]]) if s else None, len(convs), len(children.get(s, [])), sum(b not in children for b in below), saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    return sorted((tuple(r[n] for n in NAMES) for r in trie.op12_prefix_trie(spark, str(tmp_path)).collect()), key=repr)


def test_shared_prefixes_ties_and_nulls(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for c in [*range(12), *range(100, 112), 205, 300]:
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([t, t, None, 0]), rng.choice(["user", None, "assistant"]), rng.choice(["é a", "b", None])))
    rows += [(None, 0, "user", "x"), rows[0], rows[0]]
    assert _got(spark, tmp_path, rows) == _plain(rows)


@pytest.mark.parametrize("bits", [2])
def test_long_conversations_and_copies(spark, tmp_path, monkeypatch, bits):
    """One conversation with most rows, prefixes of it, a chain of branches, and many copies; blocks and pieces are small."""
    monkeypatch.setattr(trie, "BLOCK_BITS", bits)
    monkeypatch.setattr(digests, "PIECE", 3)
    long = [("user", f"t{k % 7}") for k in range(45)]
    seqs = {1: long, 2: long[:20], 3: long[:20], 7: [*long[:30], ("user", "other"), ("user", "more")], 9: [*long[:30], ("user", "other"), ("user", "end")]}
    seqs |= {k: long[:4] for k in range(110, 130)}
    rows = [(c, t, r, x) for c, s in seqs.items() for t, (r, x) in enumerate(s)]
    assert _got(spark, tmp_path, rows) == _plain(rows)


def test_empty_long_text_and_clashing_columns(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert _got(spark, tmp_path / "none", []) == []
    rows = [(1, 0, "user", "w " * 300_000, 1, "x", 2), (2, 0, "user", "w " * 300_000, 2, "y", 3)]
    assert _got(spark, tmp_path, rows, f"{SCHEMA}, pos int, name string, `a.b` int") == _plain([r[:4] for r in rows])


def test_names_are_dense(spark):
    rows = spark.range(0, 300, 1, 5).selectExpr("id % 40 as a", "id % 3 as b")
    names = trie.dense_names(rows, ["a", "b"], "n").collect()
    assert sorted(r.n for r in names) == list(range(120)) and len({(r.a, r.b) for r in names}) == 120
