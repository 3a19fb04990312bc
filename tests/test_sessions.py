"""The session queries against DuckDB, and edge rows of single rules."""

import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionspark.functions import audio, extraction, geometry
from sessionspark.operators import lifecycle, messages, patterns, quality, questions, strikes, turns
from sessionspark.plans import queries as plans
from sessionspark.streaming import state


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, same, name):
    same(spark, plans.QUERIES[name], plans.ORACLES[name])


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)


def _one(spark, text, rule):
    return spark.createDataFrame([(text,)], "t string").select(rule(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "rule", "want"),
    [
        ("+919876543210", extraction.phone, "+9198765432"),
        ("+91 9876543210", extraction.phone, "1 9876543210"),
        ("(415) 555-1234", extraction.phone, "(415) 555-1234"),
        ("Bachelor of Science in Computer Science, MIT, 2018", extraction.education, ["Bachelor"]),
        ("B.Tech in CSE, IIT", extraction.education, ["B.Tech"]),
        ("Some members became better", extraction.education, ["me"]),
        ("Curriculum Vitae\nAna Lopez\n", extraction.name, "Ana Lopez"),
        ("javascript", extraction.skills, ["Java", "Javascript", "R"]),
        ("https://netflix.com", extraction.link_class, "twitter"),
        ("mailto:a@b.co", extraction.link_class, "email"),
        ("2020 - 2018", lambda t: extraction.experience_years(t, 2024), 0.0),
        ("2018 - 2020, 2021 – Present", lambda t: extraction.experience_years(t, 2024), 5.0),
        ("ValidationError", lifecycle.error_code, "validation"),
    ],
)
def test_edge_rows(spark, text, rule, want):
    assert _one(spark, text, rule) == want


def _reports(spark, values):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, 1, at + dt.timedelta(seconds=k), "no_face", v) for k, v in enumerate(values, 1)], "event_id long, interview_id long, ts timestamp, event_type string, confidence double")


def test_strikes_stop_at_the_limit_and_the_manager_does_not(spark):
    reports = _reports(spark, [0.59, 0.6, 0.9, 0.9])
    assert [r.event_id for r in strikes.timeline(reports, 2).orderBy("event_id").collect()] == [2, 3]
    assert [r.current_strikes for r in strikes.manager_replay(reports, 2).orderBy("event_id").collect()] == [0, 1, 2, 3]


def test_percent_is_half_even(spark):
    assert spark.range(1).select(strikes.percent(F.lit(0.625))).first()[0] == "62%"


@pytest.mark.parametrize(("speech", "want"), [([1] * 4 + [0], [False] * 5), ([1] * 5 + [0] * 12, [False] * 4 + [True] * 12 + [False])])
def test_latch(spark, speech, want):
    rows = spark.createDataFrame([(1, k, s) for k, s in enumerate(speech)], "session int, frame_no int, speech int")
    assert [r.speaking for r in turns.latch(rows).orderBy("frame_no").collect()] == want


@pytest.mark.parametrize(("frames", "n"), [([0, 30], 1), ([0, 31], 2)])
def test_turn_gap(spark, frames, n):
    assert turns.turn_spans(spark.createDataFrame([(1, f, True) for f in frames], "session int, frame_no int, speech boolean")).count() == n


def test_quotas_fall_short():
    assert [sum(questions.quotas(n).values()) for n in (7, 15, 25)] == [6, 14, 24]


def test_empty_frame(spark):
    row = spark.createDataFrame([([],)], "x array<double>").select(audio.energy(F.col("x")), audio.zero_crossings(F.col("x")), audio.peak(F.col("x"))).first()
    assert tuple(row) == (0.0, 0.0, 0.0)


def test_stream_equals_batch(spark, tmp_path):
    reports = _reports(spark, [0.7, 0.2, 0.8, 0.9])
    reports.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reports.schema).parquet(str(tmp_path / "in"))
    out = state.run_stream(stream, "interview_id", state.strike_step(2), state.STRIKES, "n long")
    query = out.writeStream.format("memory").queryName("strikes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(spark.table("strikes").collect()) == sorted(state.run_batch(reports, "interview_id", state.strike_step(2), state.STRIKES).collect())


def test_messages_that_are_no_object(spark):
    raw = [None, "", "[1]", "{", "7", '{"type": "audio", "data": "AAA="}', '{"type": "cheating_detected"}', "{}"]
    got = messages.demux(spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, raw string")).orderBy("k").collect()
    assert [r.route for r in got] == ["error"] * 5 + ["audio", "cheating_detected", "ignored"]
    assert got[5].data == "AAA=" and got[6].confidence == 0.0


def test_base64_samples(spark):
    rows = spark.createDataFrame([([0, -1, 32767, -32768],), ([],)], "x array<int>")
    assert [r[0] for r in rows.select(messages.base64_pcm(messages.pcm_base64(F.col("x")))).collect()] == [[0, -1, 32767, -32768], []]
    assert [_one(spark, t, messages.base64_pcm) for t in ("AQI=", "AQID", "!", None)] == [[513], [513], None, None]


def test_upload_checks(spark):
    files = spark.createDataFrame([("a.PDF", 10), ("a.exe", 10), ("a.txt", 11 << 20), (None, 1)], "name string, n long")
    got = quality.broken(files, {"upload": quality.upload(F.col("name"), F.col("n"))}).first()
    assert (got.checked, got.broken) == (4, 3)


def test_gaze_without_points(spark):
    schema = "p array<struct<x:double,y:double>>, faces int"
    width = [(0.0, 0.0)] * 3 + [(1.0, 0.0)] + [(0.0, 0.0)] * 5 + [(1.0, 0.0)] + [(0.0, 0.0)] * 2
    rows = spark.createDataFrame([([(0.0, 0.0)] * 5, 1), ([(0.0, 0.0)] * 14, 1), ([*width, (0.5, 0.0), None], 1), ([*width, (0.5, 0.0), (0.5, 0.0)], 0)], schema)
    _, direction, confidence = geometry.gaze(F.col("p"), [0, 1, 2, 3], [6, 7, 8, 9], (12, 13))
    got = rows.select(direction, confidence, geometry.looking_away(direction, confidence, F.col("faces"))).collect()
    assert [tuple(r) for r in got] == [("center", 0.6, False), ("center", 0.5, False), ("away", 0.5, True), ("center", 0.9, True)]


def test_parents_without_children(spark):
    rows = spark.createDataFrame([(1, 2), (1, 1)], "id int, n int")
    got = lifecycle.children(spark.createDataFrame([(1,), (2,)], "id int"), rows, "id", ["n"], [], "rows").orderBy("id").collect()
    assert [[x.n for x in r.rows] for r in got] == [[1, 2], []]


@pytest.mark.parametrize(("text", "want"), [("```json\n[1]\n```", "[1]"), (" x ``` ", "x ```"), ("", "")])
def test_fences(spark, text, want):
    assert _one(spark, text, messages.unfenced) == want


def test_disconnects_of_a_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(k, s, at + dt.timedelta(minutes=m), t) for k, (s, m, t) in enumerate([(1, 0, "audio"), (1, 5, "text"), (2, 0, "audio"), (2, 1, "end_interview"), (3, 500, "text")])], "event_id long, session long, ts timestamp, type string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    query = state.disconnects(stream, "10 minutes").writeStream.format("memory").queryName("gone").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.session, r.messages, r.last_type) for r in spark.table("gone").collect()] == [(1, 2, "text")]  # the third may go on
    assert sorted(r.session for r in state.disconnects(rows, "10 minutes").collect()) == [1, 3]


def test_rows_without_a_key(spark):
    rows = _reports(spark, [0.7, 0.8]).withColumn("interview_id", F.lit(None).cast("long"))
    assert state.run_batch(rows, "interview_id", state.strike_step(2), state.STRIKES).count() == 0


def test_halves_of_a_long_session(spark):
    """Early and late rates of the last 100 samples, past the first hundred too."""
    rng = random.Random(9)
    away = [int(rng.random() < (0.2 if k % 90 < 45 else 0.7)) for k in range(330)]
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(k, 1, at + dt.timedelta(seconds=k), a) for k, a in enumerate(away)], "event_id long, session long, ts timestamp, away int")
    got = {r.event_id: (r.early, r.late) for r in patterns.gaze_patterns(rows).collect()}
    for k in range(330):
        held = away[max(0, k - 99) : k + 1]
        half = len(held) // 2
        want = (sum(held[:half]) / half if half else None, sum(held[half:]) / (len(held) - half))
        assert got[k][1] == pytest.approx(want[1]) and (got[k][0] is None if want[0] is None else got[k][0] == pytest.approx(want[0]))
