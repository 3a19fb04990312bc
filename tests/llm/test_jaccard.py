"""Near copies of the pipeline against brute force over five-word shingles."""

import random

import numpy as np

import corpus_pipeline
from sessionspark.llm import jaccard


def _sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def _groups(texts):
    sets, group = [_sets(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if _similar(a, sets[j]) and group[i] != group[j]:
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def test_pipeline_keeps_one_of_texts_with_similarity_of_four_fifths(spark):
    rng = random.Random(5)
    texts = []
    for base in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 12, 60, 200]))]
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 5, 8):
            w = list(words)
            for at in rng.sample(range(len(w)), min(edits, len(w))):
                w[at] = f"x{base}{edits}{at}"
            texts.append(" ".join(w))
    texts += [texts[3].upper(), "  " + texts[3], "", None, "one two"]
    group = _groups(texts)
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == set(group)
    assert len(kept) < len(texts) - 20


def test_false_links_are_looked_through_again(spark, monkeypatch):
    """With radii that take every pair, most links of the forests are false; the groups stay right."""
    monkeypatch.setattr(jaccard, "RADIUS", 64)
    monkeypatch.setattr(jaccard, "WIDE", 256)
    monkeypatch.setattr(jaccard, "SUB", 4)
    rng = random.Random(6)
    texts = []
    for _ in range(8):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for at in range(4):
            texts.append(" ".join(words[:at] + [f"y{at}"] + words[at + 1 :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r.doc_id: r.label for r in jaccard.group_similar(docs, keys=["doc_id"]).collect()}
    first = {}
    assert [first.setdefault(labels[k], k) for k in range(len(texts))] == _groups(texts)


def test_groups_are_looked_through_by_their_labels(spark, monkeypatch):
    """After the true links only links between the labels are left, so a large group's candidates are not contracted three times."""
    monkeypatch.setattr(jaccard, "RADIUS", 64)
    monkeypatch.setattr(jaccard, "WIDE", 256)
    calls, components = [], jaccard.connected_components

    def counted(links):
        calls.append({frozenset(r) for r in links.collect()})
        return components(links)

    monkeypatch.setattr(jaccard, "connected_components", counted)
    words = [[f"w{base}x{k}" for k in range(60)] for base in range(3)]
    texts = [" ".join([*words[base][:at], "y", *words[base][at + 1 :]]) for base in range(3) for at in range(2, 8)]
    texts += [" ".join(words[0][:30] + words[1][30:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r.doc_id: r.label for r in jaccard.group_similar(docs, keys=["doc_id"]).collect()}
    first = {}
    assert [first.setdefault(labels[k], k) for k in range(len(texts))] == _groups(texts)
    assert len(calls) == 3
    label = {x: x for link in calls[0] for x in link}
    for _ in label:
        for link in calls[0]:
            label |= dict.fromkeys(link, min(label[x] for x in link))
    assert all(label.get(x, x) == x for link in calls[1] | calls[2] for x in link)


def test_recall_of_sketches_at_the_least_similarity():
    rng, found = np.random.default_rng(0), 0
    for _ in range(500):
        a = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        b = np.concatenate([a[:89], rng.integers(0, 1 << 63, 11, dtype=np.uint64)])
        far = np.bitwise_count(jaccard.sketches(a, np.array([0, 100]))[1] ^ jaccard.sketches(b, np.array([0, 100]))[1])[0]
        found += far[0] <= jaccard.RADIUS and far.sum() <= jaccard.WIDE
    assert found >= 495
