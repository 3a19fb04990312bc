"""The pipeline's stages against plain Python on whole tables, with further columns whose names clash with the operators'."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionspark.llm import langid, textio

sys.path.insert(0, str(Path(__file__).parent))
from test_bounds import _plain_hits  # noqa: E402
from test_jaccard import _groups  # noqa: E402
from test_langid import _plain  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
EXTRA = {"_hash": "'h'", "_row": "1", "_doc": "'d'", "_text": "'t'", "my col": "'m'", "a.b": "'x'", "row": "2", "label": "'l'", "score": "0.5D", "keys": "array(1)", "m": "map('k', 1)"}


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id in (3, 5)")).withColumns({k: F.expr(v) for k, v in EXTRA.items()})
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(textio.save(stage(spark, out[-1], FOLDER), name)[0])
    return out


def _ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_pass_unharmed(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert {(r._hash, r._row, r._doc, r._text, r["my col"], r["a.b"], r.row, r.label, r.score, tuple(r["keys"]), r.m["k"]) for r in df.collect()} == {("h", 1, "d", "t", "m", "x", 2, "l", 0.5, (1,), 1)}


def test_language(stages):
    model = langid.fit(stages[0])
    rows = stages[0].collect()
    short = [r for r in rows if len(r.text or "") < 600]
    kept = _ids(stages[1])
    for r in short:
        label, score = _plain(model, r.text or "")
        if abs(score - corpus_pipeline.LEAST_SCORE) > 1e-3:
            assert (r.doc_id in kept) == (label != "und" and score >= corpus_pipeline.LEAST_SCORE)
    assert kept.count(3) == 2 * (3 in kept)


def test_near_copies(stages):
    rows = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    group = _groups([r.text for r in rows])
    assert _ids(stages[2]) == sorted(rows[g].doc_id for g in set(group))


def test_benchmark_passages(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert _ids(stages[3]) == sorted(r.doc_id for r in stages[2].collect() if not _plain_hits(r.text, items)[0])
    assert len(_ids(stages[3])) < len(_ids(stages[2]))


def test_source_weights(stages):
    texts = {r.doc_id: r for r in stages[3].collect()}
    sizes, taken, pieces = {}, {}, {}
    for r in texts.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in stages[4].collect():
        words, whole = r.text.split(), texts[r.doc_id].text
        assert r.text in whole and r.n_chars == len(r.text) and r.source == texts[r.doc_id].source
        taken[r.source] = taken.get(r.source, 0) + len(words)
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + len(words)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = sum(sizes.values()) / sum(1 + k % 3 for k in range(len(names)))
    capped = {s: min(share * (1 + k % 3), 3 * sizes[s]) for k, s in enumerate(names)}
    if all(share * (1 + k % 3) <= 3 * sizes[s] for k, s in enumerate(names)):
        assert all(abs(taken[s] - capped[s]) <= 0.02 * capped[s] + 5 for s in names)
    assert all(n <= 3 * len(texts[k].text.split()) for k, n in pieces.items())


def test_token_ids(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in stages[4].collect() for ids in [[*t.encode(r.text, add_special_tokens=False).ids, 2]])
    got = stages[5].collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens


def test_run_leaves_its_result_only(spark):
    before = set(textio._written)
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert len(textio._written - before) == 1
