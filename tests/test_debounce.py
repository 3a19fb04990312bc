"""The debounce by successors against the rule step by step, and both as streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionspark.operators import debounce
from sessionspark.streaming import state

SCHEMA = "event_id long, session long, ts timestamp, faces int"
T0 = dt.datetime(2024, 1, 1)


def _rows(seed, n=400, step=2000):
    rng = random.Random(seed)
    t, rows = 0, []
    for k in range(n):
        t += rng.choice([0, 1, step, step, 2 * step])
        rows.append((k, rng.choice([1, 1, 1, 2, None]), T0 + dt.timedelta(milliseconds=t), rng.choice([0] * 12 + [1, 2, 3, None])))
    return rows


def _plain(rows, quiet):
    last, out = {}, []
    for i, s, ts, faces in sorted(rows, key=lambda r: (r[2], r[0])):
        if s is None:
            continue
        now = (ts - T0) // dt.timedelta(milliseconds=1)
        if s not in last or faces == 1:
            last[s] = now
        if faces is not None and faces > 1:
            out.append((i, s, "multiple_faces"))
        elif faces == 0 and now - last[s] > quiet:
            out.append((i, s, "no_face"))
            last[s] = now
    return sorted(out)


@pytest.mark.parametrize("seed, quiet", [(1, 3000), (2, 0), (3, 50_000), (4, 7001)])
def test_against_the_rule(spark, seed, quiet):
    rows = _rows(seed)
    assert sorted(tuple(r) for r in debounce.emitted(spark.createDataFrame(rows, SCHEMA), quiet).collect()) == _plain(rows, quiet)


def test_long_chain_and_no_rows(spark):
    rows = [(k, 1, T0 + dt.timedelta(seconds=k), 0) for k in range(700)]
    assert sorted(tuple(r) for r in debounce.emitted(spark.createDataFrame(rows, SCHEMA), 2500).collect()) == _plain(rows, 2500)
    assert debounce.emitted(spark.createDataFrame([], SCHEMA), 3000).collect() == []


def _stream(spark, tmp_path, df, parts, start):
    for k in range(parts):
        df.where(F.col("event_id") * parts >= F.lit(k) * 400).where(F.col("event_id") * parts < F.lit(k + 1) * 400).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"s{abs(hash(str(tmp_path)))}"
    start(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_debounce_as_a_stream(spark, tmp_path):
    rows = _rows(5)
    got = _stream(spark, tmp_path, spark.createDataFrame(rows, SCHEMA), 3, lambda s: state.run_stream(s, "session", state.debounce_step(3000), state.EMITTED, state.DEBOUNCE_STATE))
    assert got == _plain(rows, 3000)


def test_rate_limit_as_a_stream(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, rng.choice([1, 2]), T0 + dt.timedelta(minutes=k), rng.choice(["upload", "interview"])) for k in range(400)]
    df = spark.createDataFrame(rows, "event_id long, client long, ts timestamp, kind string")
    step = state.rate_step({"upload": 5, "interview": 9}, 3_600_000)
    want = sorted(tuple(r) for r in state.run_batch(df, "client", step, state.ALLOWED).collect())
    assert _stream(spark, tmp_path, df, 3, lambda s: state.run_stream(s, "client", step, state.ALLOWED, state.RATE_STATE)) == want
    assert 0 < sum(r[2] for r in want) < 400
