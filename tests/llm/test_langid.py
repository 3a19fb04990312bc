"""Language labels against a plain-Python field: features, chains, means; long texts, switches, ties, names of columns."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionspark.llm import langid

M = 2**64
BASE = 0x9E3779B97F4A7C15


def _mix(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % M
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB % M
    return h ^ (h >> 31)


def _slots(word):
    marked = [256, *word, 257]
    for n in (2, 3, 4):
        for i in range(len(marked) - n + 1):
            h = marked[i]
            for s in marked[i + 1 : i + n]:
                h = (h * 1_000_003 + s) % M
            yield _mix((h + (n << 56)) % M) >> 46
    yield _mix(_mix(sum((b + 1) * pow(BASE, k, M) for k, b in enumerate(word)) % M)) >> 46


def _plain(model, text):
    """(label, score) of a text, word by word, as one chain."""
    words = re.findall(rb"[A-Za-z\x80-\xff]+", text.lower().encode())
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    n, total = len(model.labels), [0.0] * len(model.labels)
    trans = np.exp(model.transition.astype(float))
    psi = [[math.exp(sum(float(model.weights[s, k]) for s in _slots(w))) for k in range(n)] for w in words]
    ahead, back = [], [[1.0] * n]
    for t, p in enumerate(psi):
        a = [p[k] * (1.0 if not t else sum(ahead[-1][j] * trans[j, k] for j in range(n))) for k in range(n)]
        ahead.append([x / sum(a) for x in a])
    for p in psi[:0:-1]:
        b = [sum(trans[j, k] * p[k] * back[0][k] for k in range(n)) for j in range(n)]
        back.insert(0, [x / sum(b) for x in b])
    for a, b in zip(ahead, back, strict=True):
        s = sum(x * y for x, y in zip(a, b, strict=True))
        total = [v + x * y / s for v, x, y in zip(total, a, b, strict=True)]
    mean = [v / len(words) for v in total]
    return model.labels[mean.index(max(mean))], max(mean)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def model(table):
    return langid.fit(table)


def test_predictions_equal_the_plain_field(spark, table, model):
    rows = {r.doc_id: r.text for r in table.collect() if len(r.text or "") < 1500}
    got = {r.doc_id: r for r in langid.identify(table, model, keys=["doc_id"]).collect()}
    for k in sorted(rows)[:40]:
        label, score = _plain(model, rows[k])
        assert got[k].lang_pred == label and abs(got[k].score - score) < 1e-4


@pytest.mark.parametrize("cut", [None, 300])
def test_texts_of_many_chains_equal_one_chain(spark, table, model, monkeypatch, cut):
    """Texts of 65 to 1,000 words, some of whose words say nothing, so that messages go far."""
    if cut:
        monkeypatch.setattr(langid, "CUT", cut)
    words = [w for r in table.where("length(text) > 300").orderBy("doc_id").limit(12).collect() for w in r.text.split()]
    rng = random.Random(4)
    texts = []
    for k, n in enumerate((65, 66, 127, 128, 129, 200, 500, 1000)):
        start = rng.randint(0, max(0, len(words) - n))
        part = [w if rng.random() < 0.5 else "zq" for w in words[start : start + n]]
        texts.append((k, " ".join((part * 20)[:n])))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), model, keys=["doc_id"]).collect()}
    for k, text in texts:
        label, score = _plain(model, text)
        assert got[k].lang_pred == label and abs(got[k].score - score) < 1e-4


def test_long_texts_are_labelled_in_slices(spark, table, model, monkeypatch):
    text = " ".join(r.text for r in table.where("length(text) > 300").limit(40).collect())
    rows = spark.createDataFrame([(1, text), (2, "x"), (3, text[:999])], "doc_id long, text string")
    whole = langid.identify(rows, model, keys=["doc_id"], runs=True).orderBy("doc_id").collect()
    monkeypatch.setattr(langid, "CUT", 700)
    cut = langid.identify(rows, model, keys=["doc_id"], runs=True).orderBy("doc_id").collect()
    assert [r.runs for r in cut] == [r.runs for r in whole] and len(whole[0].runs) > 3
    assert all(a.lang_pred == b.lang_pred and abs(a.score - b.score) < 1e-6 for a, b in zip(cut, whole, strict=True))


def test_switches_inside_a_text_are_found(spark, table, model):
    by = {}
    for r in table.where("lang is not null and length(text) between 300 and 4000").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text.split()[:40])
    langs = sorted(by)[:3]
    right = total = 0
    for k in range(min(map(len, (by[x] for x in langs)))):
        parts = [by[x][k] for x in langs]
        row = langid.identify(spark.createDataFrame([(1, " ".join(w for p in parts for w in p))], "doc_id long, text string"), model, keys=["doc_id"], runs=True).first()
        truth = [x for x, p in zip(langs, parts, strict=True) for w in p for _ in re.findall(r"[^\W\d_]+", w)]
        said = [run.lang for run in row.runs for _ in range(run.end_word - run.first_word)]
        right += sum(a == b for a, b in zip(truth, said, strict=False))
        total += len(truth)
        if k == 4:
            break
    assert right / total > 0.9


def test_ties_go_to_the_first_label(spark):
    m = langid.Model(["b", "a"])
    rows = spark.createDataFrame([(1, "word of no weight"), (2, "123"), (3, None)], "doc_id long, text string")
    assert [(r.lang_pred, round(r.score, 6)) for r in langid.identify(rows, m, keys=["doc_id"]).orderBy("doc_id").collect()] == [("b", 0.5), ("und", 0.0), ("und", 0.0)]


def test_columns_of_any_name(spark, model):
    df = spark.createDataFrame([(1, "The house of the", "x", 2, "q", {"k": 1})], "`my id` long, `a:b` string, lang_pred string, score int, `d.e` string, m map<string,int>")
    got = langid.identify(df, model, keys=["my id", "d.e", "m"], text="a:b").first()
    assert (got["my id"], got["d.e"], got["m"]) == (1, "q", {"k": 1}) and got.lang_pred in model.labels


def test_equal_rows_count_once_in_the_sample(spark):
    rows = [(7, "same text again", "en")] * 5000 + [(k, f"der text {k}", "de") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.sample(df, key="doc_id", text="text", label="lang").where("label = 'en'").count() == 1
    assert langid.sample(df, key="doc_id", text="text", label="lang").where("label = 'de'").count() == 50


def test_too_many_labels_raise(spark):
    df = spark.range(4 * langid.MOST_LABELS).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="labels"):
        langid.fit(df)
