"""Quotation links against a plain reading of the rules: passages, deeper levels, reply order, edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from sessionspark.llm import quotations, textio


def _linked(spark, said):
    rows = spark.createDataFrame(said, "conv_id long, turn long, text string")
    return sorted(quotations.link_quotations(rows).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.turn is None, r.turn or 0))


@pytest.mark.parametrize(
    ("said", "parents"),
    [
        (["a\nb", "a\nc", "c\nb", "> c\n> b"], [None, None, None, 2]),  # each line was said before, the passage only in turn 2
        (["alpha beta", "> intro\n>> alpha beta\nyes"], [None, 0]),  # nobody said the level-1 line
        (["one\n\ntwo", "one\nthree", "> one\nx", "> three\ny"], [None, None, 0, 1]),
        (["p q", "r", "> r\n>> p q\nz"], [None, None, 1]),  # level 1 goes before level 2
        (["first\n\nsecond", "other", "> second\n> \n> new\nsee"], [None, None, 0]),  # a paragraph of the passage
        (["> late\nhi", "late"], [None, None]),  # said after it was quoted
        (["HELLO   There", "> > hello there", "a > b"], [None, 0, None]),
        (["x\n> q\ny", "x\ny", "> y\nok"], [None, None, 0]),
        ([None, "", "> ", ">> \n\n"], [None] * 4),
    ],
)
def test_parents(spark, said, parents):
    assert [r.parent_turn for r in _linked(spark, [(1, t, x) for t, x in enumerate(said)])] == parents


def test_reply_order_is_depth_first(spark, monkeypatch):
    monkeypatch.setattr(quotations, "LOW_BITS", 2)
    rng = random.Random(4)
    rows, parent = [], {}
    for conv, n in ((1, 120), (2, 1), (3, 40)):
        for t in range(n):
            p = t - 1 if conv == 3 and t else rng.choice([None, *range(max(0, t - 15), t)])
            parent[conv, t] = p
            rows.append((conv, t, (f"> said {conv} {p}\n" if p is not None else "") + f"said {conv} {t}"))
    kids = {}
    for (conv, t), p in parent.items():
        kids.setdefault((conv, p), []).append(t)

    def walk(conv, at, depth):
        for t in sorted(kids.get((conv, at), [])):
            yield t, depth
            yield from walk(conv, t, depth + 1)

    rng.shuffle(rows)
    got = _linked(spark, rows)
    for conv in (1, 2, 3):
        held = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in held] == list(range(len(held)))
        assert [(r.turn, r.depth) for r in held] == list(walk(conv, None, 0))
        assert all(r.clean_text == f"said {conv} {r.turn}" for r in held)
        assert all((r.depth == 0) == (r.root_turn == r.turn) for r in held)


def test_edge_rows_and_clashing_columns(spark):
    rows = [(1, 0, "hi", "a", "b", 1), (1, 0, "hi", "c", "d", 2), (1, 1, "> hi\nyes", "e", "f", 3), (None, 0, "> hi", "g", "h", 4), (1, None, "hi", "i", "j", 5), (2, 5, "word " * 200_000, "k", "l", 6), (2, 6, "> " + "Word " * 200_000 + "\nok", "m", "n", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, parent string, `my.c d` string, depth int")
    out = quotations.link_quotations(df, keep=["parent", "my.c d", "depth"])
    assert out.columns == ["conv_id", "turn", "parent", "my.c d", "depth_", *quotations.RESULT]
    got = {r["parent"]: r for r in out.collect()}
    assert len(got) == 7 and got["c"].position == got["a"].position == 0
    assert (got["e"].parent_turn, got["e"].position, got["e"]["my.c d"], got["e"].depth_) == (0, 1, "f", 3)
    assert got["g"].position is None and got["i"].position is None and got["i"].depth == 0
    assert got["m"].parent_turn == 5 and got["m"].clean_text == "ok"
    assert quotations.link_quotations(df.limit(0)).count() == 0


def test_tables_of_the_rounds_are_deleted(spark):
    before = set(textio._written)
    quotations.link_quotations(spark.range(40).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("> m"), (F.col("id") - 1).cast("string"), F.lit("\nm"), F.col("id").cast("string")).alias("text")))
    assert len(set(textio._written) - before) == 2
