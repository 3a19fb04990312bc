"""Two inputs in event time: the stream, whose rows come late and interleaved, against the table; a plain version of the rule."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionspark.streaming import processors as P

T0 = dt.datetime(2024, 1, 1)
FRAMES, MODEL = "session long, ts timestamp, id long, speech boolean, energy double", "session long, ts timestamp, id long, said boolean"
RULE = P.SessionRule(7_680, 60_000)


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def _rows(seed, sessions=3):
    rng = random.Random(seed)
    frames, model, n = [], [], 0
    for s in range(sessions):
        t = rng.random() * 20
        for _ in range(120):
            t += rng.choice([0.256, 0.256, 0.256, 3.0, 9.0]) if rng.random() < 0.97 else 90.0
            n += 1
            frames.append((s, _at(round(t, 3)), n, rng.random() < 0.3, round(rng.random(), 3)))
            if rng.random() < 0.2:
                model.append((s, _at(round(t + rng.choice([0.0, 0.1]), 3)), n, rng.random() < 0.5))
    return frames, model


def _set(df):
    return sorted((r.session, r.at, r.kind, r.turn, r.frames, r.barge_in, None if r.floor is None else round(r.floor, 6)) for r in df.collect())


def _table(spark, frames, model):
    return P.run_table(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(model, MODEL), RULE)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _stream(spark, tmp_path, batches, delay):
    """Each batch (frames, model) is a file of either input, in the order of the batches."""
    for k, (frames, model) in enumerate(batches):
        for name, rows, schema in (("f", frames, FRAMES), ("m", model, MODEL)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"k={k}"))

    def run():
        found = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n / "*")) for n, s in (("f", FRAMES), ("m", MODEL))]
        out = P.run_stream(*found, RULE, delay)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(600)

    run()
    return spark.read.schema(P.EVENTS).parquet(str(tmp_path / "out"))


def test_rule(spark):
    frames = [(1, _at(0), 1, True, 0.5), (1, _at(0.256), 2, False, 0.1), (1, _at(7.68), 3, False, 0.2), (1, _at(7.936), 4, True, 0.3), (1, _at(10), 5, True, 0.4)]
    model = [(1, _at(7.7), 1, True), (1, _at(9), 2, False), (2, _at(200), 3, True)]
    got = _set(_table(spark, frames, model))
    assert got == [
        (1, _at(0), "turn_started", 1, None, False, None), (1, _at(7.68), "turn_complete", 1, 1, None, None), (1, _at(7.936), "turn_started", 2, None, True, None),
        (1, _at(17.68), "turn_complete", 2, 2, None, None), (1, _at(70), "session_ended", 2, 5, None, 0.2),
    ]


def test_late_and_interleaved_rows(spark, rocks, tmp_path):
    frames, model = _rows(1)
    rng = random.Random(2)
    # Rows come up to 20 s late, model events in other batches than the frames beside them.
    late = lambda rows: sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.random() * 20))
    frames, model = late(frames), late(model)
    cut = [0, 100, 220, len(frames)]
    last = max(r[1] for r in frames + model)
    batches = []
    for a, b in zip(cut, cut[1:]):
        lo, hi = frames[a][1], frames[b - 1][1]
        batches.append((frames[a:b], [m for m in model if (a == 0 or m[1] > frames[a][1]) and (b == len(frames) or m[1] <= frames[b][1])]))
    sent = [m for _, ms in batches for m in ms]
    assert sorted(sent) == sorted(model) and lo < hi
    # A row of a session of its own, with which the watermark reaches the last of the others.
    end = last + dt.timedelta(seconds=60)
    batches.append(([(99, end, 10**6, False, 0.0)], []))
    got = [r for r in _set(_stream(spark, tmp_path, batches, "60 seconds")) if r[0] != 99]
    want = [r for r in _set(P.run_table(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(model, MODEL), RULE, spark.createDataFrame([(last,)], "t timestamp"))) if r[0] != 99]
    assert got == want and {r[2] for r in got} == {"turn_started", "turn_complete", "session_ended"}


def test_rows_without_session_or_time(spark):
    assert _set(_table(spark, [(None, _at(0), 1, True, 0.1), (1, None, 2, True, 0.1)], [])) == []
    assert _set(_table(spark, [], [])) == []
    got = _table(spark, [(1, _at(0), 1, None, None), (1, _at(100), 2, None, None)], [(1, _at(1), 3, None)])
    assert [(r[2], r[6]) for r in _set(got)] == [("session_ended", None)]


def test_ties_and_repeated_rows(spark):
    """A model event at a frame's very time counts after it; a repeated frame counts again in a table."""
    frames = [(1, _at(1), 1, True, 0.1), (1, _at(1), 1, True, 0.1), (1, _at(100), 2, False, 0.1)]
    got = _set(_table(spark, frames, [(1, _at(1), 9, True)]))
    assert [r[2:6] for r in got] == [("turn_started", 1, None, False), ("turn_complete", 1, 2, None), ("session_ended", 2, 2, None)]
