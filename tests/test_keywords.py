"""Keywords of tables of any size, in one automaton and in bundles, against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from sessionspark.functions import extraction, keywords


def _texts(rng, n):
    letters = "abcdeé r+#."
    return [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))) for i in range(n)] + [(n, None), (n + 1, "")]


@pytest.mark.parametrize("bundle", [None, 900])
def test_many_keywords(spark, bundle):
    rng = random.Random(1)
    words = {"".join(rng.choice("abcdeé r+#.") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"", "r", "c#"}
    pairs = [(w, w.upper() if k % 3 else "SAME") for k, w in enumerate(sorted(words))] + [("a", "second name")]
    texts = _texts(rng, 60)
    table = spark.createDataFrame([*pairs, *pairs[:9], (None, "x"), ("x", None)], "keyword string, name string")
    rows = spark.createDataFrame([*texts, texts[0]], "id int, text string").withColumn("out", F.lit(1))
    got = sorted(((r.id, r.found) for r in keywords.with_matches(rows, F.col("text"), table, "found", bundle_bytes=bundle).collect()), key=repr)
    want = [(i, None if t is None else sorted({n for w, n in pairs if w in t})) for i, t in [*texts, texts[0]]]
    assert got == sorted(want, key=repr)


def test_ten_thousand_keywords(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(11_000)})[:10_000]
    texts = [(i, " ".join(rng.choice(words) if rng.random() < 0.3 else "zz" for _ in range(50))) for i in range(40)]
    table = spark.createDataFrame([(w, w) for w in words], "keyword string, name string")
    got = keywords.with_matches(spark.createDataFrame(texts, "id int, text string"), F.col("text"), table, "found").collect()
    assert {r.id: r.found for r in got} == {i: sorted(w for w in words if w in t) for i, t in texts}


def test_no_keywords_and_no_texts(spark):
    none = spark.createDataFrame([], "keyword string, name string")
    texts = spark.createDataFrame([("a",), (None,)], "text string")
    assert [r.f for r in keywords.with_matches(texts, F.col("text"), none, "f").collect()] == [[], None]
    some = spark.createDataFrame([("a" * 9, "n")], "keyword string, name string")
    for size in (None, 3):
        assert keywords.with_matches(texts.limit(0), F.col("text"), some, "f", bundle_bytes=size).collect() == []


def test_skills_are_lower_cased(spark):
    rows = spark.createDataFrame([("PYTHON and CI/CD",), (None,)], "text string")
    assert [r.skills for r in extraction.with_skills(rows).collect()] == [["Ci/Cd", "Python"], None]
