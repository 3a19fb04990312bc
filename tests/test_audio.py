"""Noise subtraction against a whole session in order, odd and empty frames, and the stream against the table."""

import base64
import time

import numpy as np
from pyspark.sql import functions as F

from sessionspark.functions import audio
from sessionspark.operators import messages, turns
from sessionspark.streaming import state

SCHEMA = "session int, frame_no long, x array<double>"


def _whole(xs):
    """Each frame less the noise of a session, frame by frame."""
    noise, learned, out = None, 0, []
    for x in xs:
        m = np.abs(np.fft.rfft(x)) if len(x) else None
        if len(x) < 2 or noise is not None and len(m) != len(noise):
            out.append(x)
            continue
        if learned < 50:
            noise, learned = m if noise is None else 0.95 * noise + 0.05 * m, learned + 1
        f = np.fft.rfft(x)
        out.append(np.fft.irfft(np.maximum(m - 1.5 * noise, 0.1 * m) * np.exp(1j * np.angle(f)))[: len(x)])
    return out


def _table(spark, sessions, seed=0):
    rows = [(s, k, [float(v) for v in x]) for s, xs in sessions.items() for k, x in enumerate(xs)]
    np.random.default_rng(seed).shuffle(rows)
    return spark.createDataFrame([(None if s is None else int(s), int(k), x) for s, k, x in rows], SCHEMA)


def _mixed(n, seed):
    rng = np.random.default_rng(seed)
    return [rng.normal(scale=rng.choice([0.001, 0.2, 1.0]), size=rng.choice([16, 16, 16, 17, 24, 1, 0])) for _ in range(n)]


def test_denoise_equals_the_recurrence_and_gathers_first_frames_only(spark, monkeypatch):
    rng = np.random.default_rng(0)
    frames = {s: rng.normal(size=(n, 16)) for s, n in ((1, 400), (2, 7), (None, 60))} | {3: _mixed(200, 1), 4: [np.zeros(0), np.ones(1), np.ones(24), *_mixed(30, 2)]}
    spectra = audio.noise_spectra

    def bounded(group):
        assert len(group) <= 50
        return spectra(group)

    monkeypatch.setattr(audio, "noise_spectra", bounded)
    got = {(r.session, r.frame_no): r.x for r in audio.denoise(_table(spark, frames)).collect()}
    assert len(got) == sum(map(len, frames.values()))
    for s, xs in frames.items():
        for k, want in enumerate(_whole(xs)):
            assert np.allclose(got[(s, k)], want, atol=1e-9)


def test_odd_frames_come_back_one_sample_short(spark):
    got = audio.denoise(_table(spark, {1: [np.arange(7.0), np.arange(7.0)]})).collect()
    assert [len(r.x) for r in got] == [6, 6]


def test_empty_frames_leave_the_latch_alone(spark):
    loud, empty = np.array([0.5, 0.4, -0.5, 0.3] * 4), np.zeros(0)
    frames = {1: [loud] * 4 + [empty] + [loud] + [empty], 2: [loud] * 5}
    got = {(r.session, r.frame_no): r for r in turns.voice_activity(_table(spark, frames)).collect()}
    assert [got[1, k].speaking for k in range(7)] == [False] * 4 + [False, got[2, 4].speaking, False]
    assert got[1, 4].energy is None and got[1, 5].energy == got[2, 4].energy


def test_stream_equals_the_table(spark, tmp_path):
    """Frames of several micro-batches through the stateful rule, and the windows over the whole table."""
    frames = _table(spark, {1: _mixed(160, 3), 2: _mixed(70, 4)})
    columns = ["session", "frame_no", "speech", "speaking", *(F.round(c, 6).alias(c) for c in ("energy", "zcr", "centroid", "floor"))]
    want = sorted(turns.voice_activity(audio.denoise(frames)).select(*columns).collect(), key=lambda r: (r.session, r.frame_no))
    batch = state.run_batch(frames, "session", state.voice_step(), state.VOICE, ("frame_no",)).select(*columns)
    assert sorted(batch.collect(), key=lambda r: (r.session, r.frame_no)) == want
    for part in range(3):
        frames.where(f"frame_no div 60 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    voice = state.run_stream(stream, "session", state.voice_step(), state.VOICE, state.VOICE_STATE, ("frame_no",)).select(*columns)
    voice.writeStream.format("memory").queryName("voice").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    assert sorted(spark.table("voice").collect(), key=lambda r: (r.session, r.frame_no)) == want


def test_turns_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(s, int(f), bool(rng.random() < 0.1)) for s in (1, 2, 3) for f in range(400)]
    frames = spark.createDataFrame(rows, "session long, frame_no long, speech boolean")
    want = sorted((r.session, r.frame_no, r.turn) for r in turns.turns(frames.where("speech").select("session", "frame_no")).collect())
    for part in range(2):
        frames.where(f"frame_no div 200 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = state.run_stream(stream, "session", state.turn_step(), state.TURNS, state.TURN_STATE, ("frame_no",))
    found.writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    got = spark.table("turns").collect()
    assert sorted((r.session, r.frame_no, r.turn) for r in got if r.event != "complete") == want
    spans = turns.turn_spans(frames).where("complete_frame is not null").collect()
    assert sorted((r.session, r.frame_no, r.turn) for r in got if r.event == "complete") == sorted((r.session, r.complete_frame, r.turn) for r in spans) and spans


def test_binary_frames(spark):
    rows = spark.createDataFrame([(bytearray(np.array([0.5, -1.0], "<f4").tobytes() + b"\x01"), bytearray(np.array([1, -32768], "<i2").tobytes())), (bytearray(), None)], "f binary, i binary")
    got = rows.select(messages.float32_samples("f").alias("f"), messages.int16_samples("i").alias("i")).collect()
    assert [tuple(r) for r in got] == [([0.5, -1.0], [1 / 32768, -1.0]), ([], None)]


def test_limited_samples(spark):
    rows = spark.createDataFrame([([2.0, -1.0],), ([0.5],), ([],)], "x array<double>")
    assert [r[0] for r in rows.select(audio.pcm16_limited(F.col("x"))).collect()] == [[32767, -16383], [16383], []]


def test_one_step_pipeline_equals_the_steps(spark):
    frames = _table(spark, {1: _mixed(90, 5), 2: _mixed(30, 6), None: _mixed(5, 7)})
    columns = ["session", "frame_no", "speech", "speaking", *(F.round(c, 6).alias(c) for c in ("energy", "zcr", "centroid", "floor"))]
    order = lambda r: (r.session or 0, r.frame_no)
    assert sorted(turns.voice_pipeline(frames).select(*columns).collect(), key=order) == sorted(turns.voice_activity(audio.denoise(frames)).select(*columns).collect(), key=order)


def test_time_grows_with_the_frame(spark):
    """Eight times the samples take eight times as long or so, not 64 times."""

    def seconds(rule, n):
        rows = spark.createDataFrame([([float(v) for v in np.sin(np.arange(n))], base64.b64encode((np.sin(np.arange(n)) * 32767).astype("<i2").tobytes()).decode())] * 40, "x array<double>, b string").repartition(4)
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            rows.select(F.size(rule()).alias("n")).agg(F.sum("n")).collect()
            best = min(best, time.perf_counter() - began)
        return best

    for rule in (lambda: audio.gained(F.col("x")), lambda: audio.pcm16_limited(F.col("x")), lambda: messages.base64_pcm(F.col("b"))):
        assert seconds(rule, 4096) < 24 * max(seconds(rule, 512), 0.05)


def test_centroid_of_odd_inputs(spark):
    rows = spark.createDataFrame([([],), (None,), ([1.0, 0.0],), ([0.0, 0.0, 0.0],)], "x array<double>")
    assert [r[0] for r in rows.select(audio.spectral_centroid("x")).collect()][:2] == [0.0, None]
