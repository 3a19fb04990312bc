"""The token-id file against the tokenizers library: marks in texts, pieces that share a hash, lookup by id ranges."""

import random
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from sessionspark.llm import textio, tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", " ", "  ", "   ", "\n", "\t", "<|endoftext|>", "<|endoftext", "|>", "é", " ", "　", "don't", "12", "...", "\x1c", "Hello", " world", "x" * 90]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def _texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_texts_with_marks_have_the_library_ids(library):
    encoder = tokenfile.Encoder(PATH)
    assert encoder.encode_texts(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]
    for seed in range(60):
        texts = _texts(seed, 40)
        assert [x.tolist() for x in encoder.encode_texts(texts)] == [library(t) for t in texts]


def test_pieces_that_share_a_hash_keep_their_ids(library):
    class Colliding(tokenfile.Encoder):
        def _hash(self, *span):
            return super()._hash(*span) & np.uint64(3)

    encoder = Colliding(PATH)
    for seed in range(30):
        texts = _texts(seed, 40)
        assert [x.tolist() for x in encoder.encode_texts(texts)] == [library(t) for t in texts]


def test_file_holds_the_library_ids_and_is_read_by_ranges(spark, library, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_DOCS", 7)
    texts = [*_texts(5, 200), None, "", "a <|endoftext|> b"]
    rows = [(k, t, k, "p") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "`my id` long, text string, k long, h string").repartition(3)
    got = {r["my id"]: r for r in tokenfile.encode_to_file(docs, key="my id").collect()}
    start = 0
    for k, t in enumerate(texts):
        ids = np.array([*library(t), 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = f"{textio.shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
    tokenfile.write_tokens(docs, path, tokenizer=PATH, key="my id")
    found = tokenfile.read_tokens(spark, path, [3, 202, 999])
    assert {r.doc_id: r.ids for r in found.collect()} == {k: [*library(texts[k]), 2] for k in (3, 202)}
    assert "last_id" in found._jdf.queryExecution().toString().split("PushedFilters")[1][:200]


def test_sample_takes_equal_rows_once_and_spreads_its_places(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "train_dictionary", lambda samples: b"|".join(samples))
    same = spark.createDataFrame([(1, "same text")] * 3000 + [(None, None)], "doc_id long, text string")
    assert tokenfile._sample_dictionary(same, "doc_id", "text", PATH, 2).count(b"|") == 0
    long = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("a b "), 2000), F.repeat(F.lit("c d "), 2000)).alias("text"))
    taken = {bytes(x) for x in tokenfile._sample_dictionary(long, "doc_id", "text", PATH, 2).split(b"|")}
    assert len(taken) > 5  # not the same prefix of all
