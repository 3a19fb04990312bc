"""op13 against windows in plain Python."""

import hashlib
import random
import re

import pytest

from sessionspark.llm import repeats

NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def _plain(rows, size=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - size + 1):
                g = tuple(w[k : k + size])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - size + 1):
                if first[tuple(w[k : k + size])] < i:
                    gone |= set(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(spark, rows, schema="doc_id long, text string"):
    return sorted((tuple(r[n] for n in NAMES) for r in repeats.without_repeats(spark.createDataFrame(rows, schema)).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages(spark, seed):
    """Passages of 11 to 40 words at any place, in parts, next to each other, twice in one text, and whole copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "é", "cc", "d.", "E"]) + str(rng.randint(0, 30))
    passages = [[word() for _ in range(rng.randint(11, 40))] for _ in range(6)]
    rows = []
    for i in range(70):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randint(0, 8)])
            w += [word() for _ in range(rng.randint(0, 12))] + p[a : rng.choice([len(p), len(p) - rng.randint(0, 9)])]
        rows.append((i * 3, "".join(x + rng.choice([" ", "  ", "\n", "\t "]) for x in w)))
    rows += [(500 + i, rows[i][1]) for i in range(0, 60, 7)]
    rng.shuffle(rows)
    assert _got(spark, rows) == _plain(rows)


def test_defined_cases(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(None, long), (1, None), (2, ""), (3, " \n "), (4, long), (4, long), (4, long + " more"), (9, long), (9, long), (10, "x " * 12), (11, "x " * 12), (12, "x " * 30), (13, "x " * 14), (None, None)]
    assert _got(spark, rows) == _plain(rows)
    assert _got(spark, []) == []


def test_ids_of_other_types_and_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(20))
    rows = [("b", text, 1, "x", 2), ("a", text + " y", 1, "x", 2), ("c", "z " + text, 1, "x", 2)]
    assert _got(spark, rows, "doc_id string, text string, digest int, h string, `a.b` int") == _plain([r[:2] for r in rows])


def test_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.randint(0, 9999)) for _ in range(150_000))
    rows = [(1, long), (2, "x " + long), (3, long[len(long) // 2 :])]
    assert _got(spark, rows) == _plain(rows)


def test_maximal_repeats(spark):
    """Neighbouring windows with one first document make one repeat; the bit set may be full."""
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"q {a} {b} q")], "doc_id long, text string")
    (row,) = repeats.repeats(docs).collect()
    assert row["_id"] == 3 and [tuple(r) for r in row["repeats"]] == [(1, 31, 1), (31, 61, 2)]
