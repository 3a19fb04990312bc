"""The segmented scan against the windows, on sessions of many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from sessionspark.operators import scan, strikes, turns


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(scan.blocked, "__kwdefaults__", {"bits": 4})


def _rows(df):
    return sorted(df.collect(), key=repr)


def _frames(spark, n=3000):
    rng = random.Random(1)
    rows, on = [], False
    for k in range(n):
        on = on if rng.random() < 0.9 else not on
        rows.append((1 if k % 10 else 2, k, None if rng.random() < 0.01 else int(on if rng.random() < 0.95 else not on)))
    rows += [(None, k, 1) for k in range(9)]
    return spark.createDataFrame(rows, "session int, frame_no int, speech int").repartition(4)


def test_latch(spark):
    frames = _frames(spark)
    assert _rows(scan.latch(frames).select("session", "frame_no", "speaking")) == _rows(turns.latch(frames.withColumn("speech", F.col("speech"))).select("session", "frame_no", "speaking"))


def test_turns(spark):
    speech = _frames(spark).where("speech = 1 and frame_no % 37 < 3").select("session", "frame_no")
    assert _rows(scan.turns(speech)) == _rows(turns.turns(speech))


def test_playback(spark):
    rng = random.Random(2)
    rows = [(k % 2, k, float(rng.randint(0, 4000)) + k, float(rng.randint(1, 9))) for k in range(1500)]
    chunks = spark.createDataFrame(rows, "session int, seq int, arrival double, duration double")
    assert _rows(scan.playback(chunks)) == _rows(turns.playback(chunks))


def test_stack(spark):
    rng = random.Random(3)
    ops = [(k, k % 2, k // 3, rng.choice(["add", "pop", "pop", "add", "reset" if rng.random() < 0.02 else "other"])) for k in range(1500)]
    rows = spark.createDataFrame(ops, "event_id int, interview_id int, ts int, op string")
    columns = ["event_id", "interview_id", "op", "depth"]
    assert _rows(scan.stack_depth(rows).select(*columns)) == _rows(strikes.stack_depth(rows).select(*columns))


def test_one_session_is_many_blocks(spark):
    rows = scan.blocked(spark.range(0, 1000, 1, 4).select(F.lit(1).alias("session"), "id"), "session", "id")
    blocks = rows.groupBy("_block").count().collect()
    assert len(blocks) > 50 and max(b["count"] for b in blocks) <= 16
    assert [r.id for r in rows.orderBy("_at").collect()] == list(range(1000))


def test_equal_rows_are_dealt_out(spark):
    rows = scan.running(scan.blocked(spark.range(0, 500, 1, 4).select(F.lit(1).alias("k"), F.lit(2).alias("o")), "k", "o"), "k", {"n": ("count", F.lit(1))})
    assert sorted(r.n for r in rows.collect()) == list(range(1, 501))
    assert scan.running(scan.blocked(spark.createDataFrame([], "k int, o int"), "k", "o"), "k", {"n": ("count", F.lit(1))}).collect() == []
