"""Token counts of vocabularies with fractional scores against the tokenizers library."""

import random

import pytest

from sessionspark.llm import unigram

S = unigram.SPACE


def _library(tmp_path, seed, fallback, cut):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    rng = random.Random(seed)
    pieces = {"<unk>": -9.75}
    if fallback:
        pieces |= {f"<0x{b:02X}>": -8.0 - b / 64 for b in range(256)}
    for n in range(1, 6):
        for _ in range(25):
            pieces["".join(rng.choice("ab" + S + "é") for _ in range(n))] = -rng.choice([0.1, 0.2, 0.30000000000000004, 1.0, 2.5, 3.7]) * n
    t = Tokenizer(models.Unigram(list(pieces.items()), unk_id=0, byte_fallback=fallback))
    if cut:
        t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    else:
        t.normalizer = normalizers.Sequence([normalizers.Prepend(S), normalizers.Replace(" ", S)])
    path = str(tmp_path / f"{seed}{fallback}{cut}.json")
    t.save(path)
    return t, path


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("cut", [False, True])
def test_counts_equal_the_library(tmp_path, fallback, cut):
    for seed in range(8):
        t, path = _library(tmp_path, seed, fallback, cut)
        counter, rng = unigram.Counter(path), random.Random(seed)
        texts = ["".join(rng.choice(["a", "b", "é", " ", "  ", "ab", "z", "zz", "漢", S]) for _ in range(rng.randrange(40))) for _ in range(150)]
        texts += ["a" * 5000 + "z" * 10, "z " * 1200, ""]
        n, _ = counter.count(texts)
        assert n.tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("scores", ["ties", "any"])
def test_long_texts_of_fractional_scores_equal_the_library(tmp_path, monkeypatch, fallback, scores):
    """Pieces hold U+2581 at their begin only, as real vocabularies' do; with scores that tie, sums differ by rounding alone."""
    from tokenizers import Tokenizer, models, normalizers

    whole = []
    counted = unigram.Automaton.count_long
    monkeypatch.setattr(unigram.Automaton, "count_long", lambda self, w: whole.append(w) or counted(self, w))
    rng = random.Random(5)
    pieces = {"<unk>": -9.75, S: -2.1, "a": -1.1, "b": -1.3, "é": -1.7}
    if fallback:
        pieces |= {f"<0x{b:02X}>": -8.0 - b / 64 for b in range(256)}
    for n in range(2, 7):
        for k in range(60):
            w = "".join(rng.choice("abé") for _ in range(n - 1))
            pieces[rng.choice([S, rng.choice("abé")]) + w] = -rng.choice([0.1, 0.2, 0.3, 0.7]) * n if scores == "ties" else -rng.uniform(1, 12)
    t = Tokenizer(models.Unigram(list(pieces.items()), unk_id=0, byte_fallback=fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(S), normalizers.Replace(" ", S)])
    path = str(tmp_path / "v.json")
    t.save(path)
    counter = unigram.Counter(path)
    assert counter.cuts and not counter.whole
    word = lambda: "".join(rng.choice("aaabbé") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", "z", "漢字"])
    vocabulary = [word() for _ in range(300)]
    texts = [rng.choice([" ", "", "  "]) + " ".join(rng.choice(vocabulary) + rng.choice(["", "", " "]) for _ in range(rng.choice([3, 40, 900, 4000]))) for _ in range(40)]
    texts += ["a" * 3000 + " b", " ", "z z z", "é" * 2500]
    n, score = counter.count(texts)
    assert n.tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts] and max(map(len, texts)) > 10_000
    assert scores == "ties" or len(whole) < 10  # the texts of one long word


def test_scores_and_columns_of_a_table(spark, tmp_path):
    t, path = _library(tmp_path, 1, False, True)
    rows = [(1, "ab ba", "x", 7), (2, None, "y", 8), (2, "zz z", "z", 9)]
    df = spark.createDataFrame(rows, "`the.id` long, text string, score string, n_tokens int")
    got = unigram.count_tokens(df, keys=["the.id"], model=path).collect()
    want = {"ab ba": len(t.encode("ab ba").ids), None: 0, "zz z": len(t.encode("zz z").ids)}
    assert sorted((r["the.id"], r.n_tokens) for r in got) == sorted((k, want[x]) for k, x, *_ in rows)
    assert [r.score for r in got if r.n_tokens == 0] == [0.0] and unigram.count_tokens(df.limit(0), keys=["the.id"], model=path).count() == 0


def test_files_that_do_not_fit_are_refused(tmp_path):
    from tokenizers import Tokenizer, models

    path = str(tmp_path / "bpe.json")
    Tokenizer(models.Unigram([("a", -1.0)], unk_id=0)).save(path)
    with pytest.raises(ValueError, match="U\\+2581"):
        unigram.Counter(path)
