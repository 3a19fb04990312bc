"""Documents by suffix, upload errors, lists, updates, images, question plans, shared rate limits, reports of several faces."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sessionspark.functions import extraction, geometry
from sessionspark.operators import lifecycle, messages, questions
from sessionspark.sources import documents
from sessionspark.streaming import state


def _docx(*paragraphs):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p[:2]}</w:t></w:r><w:r><w:t>{p[2:]}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{documents.WORD}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents_are_read_by_their_suffix(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("Ana é\nline", encoding="utf-8")
    (tmp_path / "b.docx").write_bytes(_docx("Bob Bee", "Python"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF page")
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path), lambda c: F.concat(F.lit("pdf: "), F.decode(c, "UTF-8"))).collect()}
    assert {k: r.raw_text for k, r in got.items()} == {"a.TXT": "Ana é\nline", "b.docx": "Bob Bee\nPython", "c.pdf": "pdf: %PDF page"}
    assert got["b.docx"].suffix == "docx" and got["c.pdf"].n_bytes == 9
    with pytest.raises(PySparkException, match="no pdf reader"):
        documents.read_documents(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(("name", "size", "error"), [("a.exe", 3, "unsupported file format: exe"), ("a.txt", documents.MAX_BYTES + 1, "file too large")])
def test_uploads_that_are_refused(spark, tmp_path, name, size, error):
    (tmp_path / name).write_bytes(b"x" * size)
    with pytest.raises(PySparkException, match=error):
        documents.read_documents(spark, str(tmp_path)).collect()


def test_many_files_are_dealt_to_folders_and_listed_by_tasks(spark, tmp_path):
    """No file is named in the plan of the read, and a folder holds few of them."""
    path = f"file://{tmp_path}/uploads"
    rows = spark.range(0, 90).select(F.concat("id", F.lit(".txt")).alias("name"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("é "), "id")).alias("text"))
    documents.write_texts(rows, path, 10)
    root = tmp_path / "uploads"
    folders = [p for p in root.iterdir() if p.is_dir()]
    assert len(folders) == 9 and max(len(list(p.iterdir())) for p in folders) < 40
    (root / "_hidden").mkdir()
    (root / "_hidden" / "x.exe").write_bytes(b"x")
    (root / "last.TXT").write_bytes(b"last")
    found = documents.read_documents(spark, path)
    assert found.inputFiles() == []
    got = {r.path.rsplit("/", 1)[1]: (r.suffix, r.n_bytes, r.raw_text) for r in found.collect()}
    want = {f"{k}.txt": f"é {k}" if k % 9 else "" for k in range(90)} | {"last.TXT": "last"}
    assert got == {k: ("txt", len(v.encode()), v) for k, v in want.items()}


def test_docx_columns_are_read_some_values_at_a_time(spark):
    import pyarrow as pa

    seen = []
    column = pa.array([None if k % 5 == 0 else "x" * k for k in range(2000)])
    got = list(documents.by_pieces(column, lambda v: seen.append(v) or len(v), pa.int64()))
    assert max(map(len, got)) <= documents.PIECE_VALUES and len(got) > 7
    assert [v for c in got for v in c.to_pylist()] == [None if k % 5 == 0 else k for k in range(2000)]
    assert list(documents.by_pieces(pa.array([], pa.string()), len, pa.int64())) == []
    texts = [f"a{k}\nb" for k in range(700)]
    rows = spark.createDataFrame([(k, _docx(*t.split("\n")) if k % 3 else None) for k, t in enumerate(texts)], "id int, c binary").coalesce(1)
    assert {r.id: r.t for r in rows.select("id", documents.docx_text("c").alias("t")).collect()} == {k: t if k % 3 else None for k, t in enumerate(texts)}


def test_file_pattern_and_missing_path(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"a{k}.txt").write_text(str(k))
    got = documents.read_documents(spark, f"{tmp_path}/a[01].txt").collect()
    assert sorted((r.path, r.raw_text) for r in got) == [(f"file:{tmp_path}/a{k}.txt", str(k)) for k in range(2)]
    with pytest.raises(FileNotFoundError):
        documents.read_documents(spark, f"{tmp_path}/none")


def test_links_of_a_page(spark):
    pages = spark.createDataFrame([(1, '<a href="https://github.com/x">a</a><a href="mailto:a@b.co">')], "page_id long, html string")
    rows = documents.hrefs(pages).select("href", "page", extraction.link_class(F.col("href")).alias("kind")).collect()
    assert [tuple(r) for r in rows] == [("https://github.com/x", 1, "github"), ("mailto:a@b.co", 1, "email")]


def test_lists_are_filtered_searched_ordered_and_cut(spark):
    rows = spark.createDataFrame([(k, f"Name {k}", "open" if k % 2 else "done") for k in range(20)], "id int, name string, status string")
    found = lifecycle.listing(rows, filters={"status": "open"}, columns=["name"], text="NAME 1", order=[F.desc("id")], page=3).collect()
    assert [r.id for r in found] == [19, 17, 15]
    assert [r.id for r in lifecycle.listing(rows, order=[F.asc("id")], page=1).collect()] == [0]
    assert lifecycle.get(rows, "id", 5).first().name == "Name 5" and lifecycle.get(rows, "id", 99).count() == 0


def test_partial_updates_leave_other_fields(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7)], "id int, s string, n int")
    changes = spark.createDataFrame([(2, None, 0), (9, "z", 0), (None, "q", 0)], "id int, s string, n int")
    got = sorted(map(tuple, lifecycle.update_fields(rows, changes, "id", ["s"]).collect()), key=repr)
    assert got == sorted([(1, "a", 5), (2, None, 6), (None, "c", 7)], key=repr)
    assert lifecycle.append(rows, spark.createDataFrame([(4,)], "id int")).where("id = 4").first().s is None


def test_iso_times(spark):
    at = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 60), None]
    rows = spark.createDataFrame([(t,) for t in at], "t timestamp_ntz")
    assert [r[0] for r in rows.select(lifecycle.iso(F.col("t"))).collect()] == [t and t.isoformat() for t in at]


def test_images(spark):
    texts = ["data:image/png;base64,iVBORw0KGgo=", "/9j/4AAQ", "AAAA", "???", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] is not None for r in rows.select(messages.image_bytes(F.col("t"))).collect()] == [True, True, False, False, False, False]


def test_no_face_looks_away(spark):
    rows = spark.createDataFrame([([(0.0, 0.0)] * 14, 0)], "p array<struct<x:double,y:double>>, faces int")
    ratio, direction, confidence = geometry.gaze(F.col("p"), [0, 1, 2, 3], [6, 7, 8, 9], (12, 13), F.col("faces"))
    assert tuple(rows.select(ratio, direction, confidence, geometry.looking_away(direction, confidence, F.col("faces"))).first()) == (0.0, "away", 0.9, True)


def test_plans_draw_templates_of_their_category_and_difficulty(spark):
    people = spark.createDataFrame([(k, ["fresher", "lead", "unknown"][k % 3], [["Sql", "Go"], []][k % 2]) for k in range(300)], "id int, level string, skills array<string>")
    rows = questions.plan(people, 10, key="id", level="level", skills="skills").collect()
    assert len(rows) == 3000
    for r in rows:
        templates = questions.TEMPLATES[r.category][r.difficulty]
        assert r.text in [t.replace("{skill}", r.skill_tag) if r.skill_tag else t for t in templates]
        assert (r.skill_tag != "") == (r.category == "technical" and r.id % 2 == 0)
    for level, k in (("fresher", 0), ("lead", 1), ("mid", 2)):
        held = [r.difficulty for r in rows if r.id % 3 == k]
        for name, weight in zip(questions.DIFFICULTIES, questions.WEIGHTS[level], strict=True):
            assert abs(held.count(name) / len(held) - weight) < 0.06
    assert len({tuple(r.category for r in sorted((r for r in rows if r.id == k), key=lambda r: r.position)) for k in range(50)}) > 25  # shuffled
    assert sorted(r.position for r in rows if r.id == 1) == list(range(10))


@pytest.mark.parametrize("n", [0, 1, 3, 7])
def test_plans_are_cut(spark, n):
    people = spark.createDataFrame([(1, "mid", ["Go"])], "id int, level string, skills array<string>")
    assert questions.plan(people, n, key="id", level="level", skills="skills").count() == min(n, sum(questions.quotas(n).values()))


def test_kinds_of_requests_share_a_history(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(k, 1, at + dt.timedelta(minutes=m), kind) for k, (m, kind) in enumerate([(0, "many"), (1, "few"), (2, "few"), (3, "many"), (4, "many"), (62, "few")])], "event_id long, client long, ts timestamp, kind string")
    got = state.run_batch(rows, "client", state.rate_step({"few": 1, "many": 3}, 3_600_000), state.ALLOWED).orderBy("event_id").collect()
    assert [r.allowed for r in got] == [True, False, False, True, True, False]


def test_several_faces_are_reported_each_time_and_reset_nothing(spark):
    at = dt.datetime(2024, 1, 1)
    faces = [2, 0, 2, 0, 0, 1, 0]
    rows = spark.createDataFrame([(k, 1, at + dt.timedelta(seconds=2 * k), n) for k, n in enumerate(faces)], "event_id long, session long, ts timestamp, faces int")
    got = state.run_batch(rows, "session", state.debounce_step(3000), state.EMITTED).orderBy("event_id").collect()
    assert [(r.event_id, r.event_type) for r in got] == [(0, "multiple_faces"), (2, "multiple_faces"), (3, "no_face")]


def test_client_messages_of_a_stream(spark, tmp_path):
    """Messages are rows that a stream appends."""
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "interview_id long, strike_number long")
    rows.write.parquet(str(tmp_path / "in"))
    sent = messages.strike_messages(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 3)
    sent.writeStream.format("memory").queryName("sent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    bodies = [r.body for r in spark.table("sent").orderBy("strike_number").collect()]
    assert '"max_strikes":3' in bodies[0] and bodies[2].startswith('{"type":"terminated"')
