"""The corpus operators against SQL, brute force, and edge rows: nulls, empty tables, repeated and clashing rows."""

import random
import re
import uuid
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sessionspark.llm import components, decontamination, kdtree, langid, merkle, mixing, queries, quotations, sharding, simhash, textio, tokenfile, unigram

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def _text(seed, n):
    return " ".join(random.Random(seed).choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "  \n ", "12 34", "Éa ñ ß", _text(1, 40), _text(1, 40), _text(2, 5000), "x" * 9000, " a  b \n c ", "alpha"] + [_text(k, 30) for k in range(10, 40)]
    out = [(k, t, ["en", "de", None][k % 3], ["s0", "s1", None, "é"][k % 4], len(t or ""), "s", "f") for k, t in enumerate(texts)]
    return [*out, out[5], (None, "no id", "en", "s0", 5, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, same, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(none, items, keys=["doc_id"]).count() == 0
    assert mixing.mix(none, keys=["doc_id"])[0].count() == 0
    assert langid.identify(none, langid.fit(none), keys=["doc_id"]).count() == 0
    assert simhash.group_near_duplicates(none, keys=["doc_id"]).count() == 0
    assert sharding.shard_by_row_number(none, 3).count() == 0
    assert tokenfile.encode_to_file(none).count() == 0
    assert unigram.count_tokens(none, keys=["doc_id"]).count() == 0
    vectors = kdtree.scaled_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert kdtree.top_inner_products(vectors, vectors, 5).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert merkle.fixity_report(pages, pages).count() == 0
    assert quotations.link_quotations(spark.createDataFrame([], "conv_id long, turn long, text string")).count() == 0


def test_decontamination_windows(spark, docs):
    items = spark.createDataFrame([(1, "x " + _text(12, 30)), (2, "Alpha"), (3, None), (None, _text(1, 40)), (2, "alpha")], "item_id long, text string")
    found = {(r.doc_id, r.n_words): r for r in decontamination.decontaminate(docs, items, keys=["doc_id"]).collect()}
    assert found[(13, 30)].n_items >= 1 and found[(13, 30)].n_hit == 30
    assert found[(10, 1)].n_hit == 1 and not found[(0, 0)].contaminated and found[(None, 2)].n_items == 0


def test_simhash_against_brute_force(spark, docs, rows):
    def fp(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    lower = [("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if r[1] else r[1], r[0]) for r in rows]
    prints = [fp(t) for t, _ in lower]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = sorted(((r[0], p, least[g]) for r, p, g in zip(rows, prints, group, strict=True)), key=repr)
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.group_near_duplicates(docs, keys=["doc_id"]).collect()]
    assert sorted(got, key=repr) == want


def test_stars_span_all_links():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30))])
    values = np.unique(near)
    u, v = simhash.stars(values, values, True, 4)
    label = {int(x): int(x) for x in values}
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = label[a], label[b]
        label = {k: min(x, y) if g in (x, y) else g for k, g in label.items()}
    for a in values.tolist():
        for b in values.tolist():
            if (a ^ b).bit_count() <= 4:
                assert label[a] == label[b]


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.label for r in components.connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}


def test_components_have_a_row_for_each_link_in_a_round(spark, monkeypatch):
    """Links are not turned round: a large star, in many batches, makes no more rows than it has links."""
    made, save = [], components.save

    def kept(df, name):
        made.append(df._jdf.queryExecution().optimizedPlan().toString())
        return save(df, name)

    monkeypatch.setattr(components, "save", kept)
    links = spark.range(1, 300, 1, 8).select(F.col("id").alias("u"), (F.col("id") % 2 * 1000).alias("v")).unionByName(spark.createDataFrame([(0, 1000), (2000, 2001)], "u long, v long"))
    got = {r.node: r.label for r in components.connected_components(links).collect()}
    assert got == {k: 0 for k in [*range(300), 1000]} | {2000: 2000, 2001: 2000}
    assert len(made) > 1 and not any("Generate" in plan for plan in made)


def test_targets_reshare():
    assert mixing.targets([1, 100, 100], [1, 2, 3]) == pytest.approx([3, 198 * 2 / 5, 198 * 3 / 5])


def test_token_file(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {(r[0], r[1]): t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    got = sorted(tokenfile.encode_to_file(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    start = 0
    for r in got:
        assert r.start == start
        assert (r.n_tokens, r.ids_crc32) in {(len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for (k, _), v in ids.items() if k == r.doc_id}
        start += r.n_tokens
    path = f"{textio.shared_folder(spark)}/lookup-{uuid.uuid4().hex}"
    tokenfile.write_tokens(docs, path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenfile.read_tokens(spark, path, [9]).first().ids == ids[(9, rows[9][1])]


def test_token_counts_equal_the_library(spark, docs, rows):
    from tokenizers import Tokenizer, models, normalizers

    import public_tokenizers

    pieces = unigram.Counter(public_tokenizers.path("piece_bpe_32k.model")).pieces
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    got = sorted((r.doc_id, r.n_tokens) for r in unigram.count_tokens(docs, keys=["doc_id"]).collect() if r.doc_id is not None)
    assert got == sorted((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows if r[0] is not None)


def test_language_held_out_accuracy(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(table, langid.fit(table), keys=["doc_id", "lang"]).where(langid.held_out())
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    edge = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs), keys=["doc_id"], runs=True).collect()}
    assert all(edge[k].lang_pred == "und" and edge[k].score == 0 for k in range(4)) and edge[4].lang_pred != "und"


def test_forward_backward_by_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    weight = {y: np.exp(sum(e[i, k] for i, k in enumerate(y)) + sum(t[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product(range(3), repeat=4)}
    want = np.array([[sum(w for y, w in weight.items() if y[i] == k) for k in range(3)] for i in range(4)]) / sum(weight.values())
    assert np.allclose(langid.forward_backward(e, np.array([0]), np.array([4]), t)[0], want)


def test_top_k_with_ties_and_unusable_vectors(spark):
    rng = random.Random(3)
    data = [(k, [float(rng.randint(-3, 3)) / 64 for _ in range(3)]) for k in range(700)] + [(1000, None), (1001, [1.0, None, 1.0]), (1002, [float("nan")] * 3), (None, [1.0] * 3)]
    vectors, _ = textio.save(kdtree.scaled_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in kdtree.top_inner_products(vectors.where("vec_id % 100 = 0"), vectors, 5).collect()}
    v = {k: [int(np.floor(64 * c)) for c in x] for k, x in data[:700]}
    for q in range(0, 700, 100):
        want = sorted(((-sum(a * b for a, b in zip(v[q], v[k], strict=True)), k) for k in v if k != q))[:5]
        assert [got[(q, i + 1)] for i in range(5)] == [(k, -s) for s, k in want]


def test_quotes_of_other_threads_and_nulls(spark):
    said = [(1, 0, "Hello there"), (1, 1, "> hello  THERE\nhi"), (1, 2, "> hi\n>> hello there\nbye"), (1, 3, "> never said\nwell"), (None, 0, "> hi"), (2, 0, None)]
    got = {(r.conv_id, r.turn): r for r in quotations.link_quotations(spark.createDataFrame(said, "conv_id long, turn long, text string")).collect()}
    assert [(got[(1, t)].parent_turn, got[(1, t)].depth, got[(1, t)].clean_text) for t in range(4)] == [(None, 0, "Hello there"), (0, 1, "hi"), (1, 2, "bye"), (None, 0, "well")]
    assert got[(1, 2)].root_turn == 0 and got[(2, 0)].clean_text == ""


def test_equal_replicas(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, None, None)], "page_id long, url string, html string")
    assert [r.status for r in merkle.fixity_report(pages, pages).collect()] == ["intact"] * 3


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_pipeline_stages_take_edge_rows(spark, docs, n):
    """Nulls, repeated rows, clashing columns, one row and none: every stage keeps the columns, and texts that it keeps are whole."""
    folder = "/root/testdata/sf0.001"
    now = docs.where("doc_id = 12") if n == 1 else docs.limit(n)
    whole = {r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now, _ = textio.save(stage(spark, now, folder), name)
        assert now.columns == docs.columns
        if name != "source_weights":
            assert {r.text for r in now.collect()} <= whole - {None, "", "  \n ", "12 34"}
    got = corpus_pipeline.token_ids(spark, now, folder)
    assert got.count() == now.count() and (got.count() > 0) == (n > 0)
