"""Recordings by byte ranges and as a stream, key-hashed tables, the exactly-once writer, links, details, records."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sessionspark.operators import lifecycle, variants
from sessionspark.sources import keyed, links, recordings
from sessionspark.streaming import ledger

MESSAGES = "session long, seq long, kind string, payload binary"


def _messages(n, seed=1):
    rng = random.Random(seed)
    return [(rng.randint(0, 4), k, rng.choice(["binary", "json"]), bytearray(rng.randbytes(rng.choice([0, 1, 40, 300])))) for k in range(n)]


def _write(spark, rows, path, parts=2, block=500):
    recordings.register(spark)
    spark.createDataFrame(rows, MESSAGES).repartition(parts, "seq").write.format("recording").option("path", path).option("blockBytes", block).mode("append").save()


def _seen(df):
    return sorted((r.session, r.seq, r.kind, bytes(r.payload)) for r in df.collect())


@pytest.mark.parametrize("step", [7, 100, 1000, 1 << 20])
def test_every_block_is_read_once_whatever_the_ranges(tmp_path, step):
    """A payload that holds the mark itself is no block."""
    rows = [*((m[0], m[1], m[2], bytes(m[3])) for m in _messages(60)), (1, 100, "binary", recordings.MARK * 3)]
    data = b"".join(recordings.block(rows[k : k + 7]) for k in range(0, len(rows), 7))
    (tmp_path / "a.rec").write_bytes(data)
    found = []
    for part in recordings.ranges(str(tmp_path / "a.rec"), 0, len(data), step):
        for b in recordings.read(part, str(tmp_path)):
            found += [tuple(r.values()) for r in b.to_pylist()]
    assert sorted(found) == sorted(rows)


def test_recordings_of_a_table(spark, tmp_path):
    rows, path = _messages(400), f"file://{tmp_path}/r"
    _write(spark, rows, path)
    read = spark.read.format("recording").option("rangeBytes", 900).load(path)
    assert read.rdd.getNumPartitions() > 20
    assert _seen(read) == sorted((a, b, c, bytes(x)) for a, b, c, x in rows)
    one = read.where("session = 3 and kind = 'json'")
    assert _seen(one) == sorted((a, b, c, bytes(x)) for a, b, c, x in rows if a == 3 and c == "json")
    _write(spark, [], f"file://{tmp_path}/none")
    assert spark.read.format("recording").load(f"file://{tmp_path}/none").collect() == []


def test_blocks_without_a_session_are_passed_over(tmp_path):
    data = recordings.block([(1, 1, "json", b"a"), (2, 2, "json", b"b")]) + recordings.block([(7, 3, "json", b"c")])
    (tmp_path / "a.rec").write_bytes(data)
    (part,) = recordings.ranges(str(tmp_path / "a.rec"), 0, len(data), 1 << 20)
    assert [b.num_rows for b in recordings.read(part, str(tmp_path), 7)] == [1]
    assert [b.num_rows for b in recordings.read(part, str(tmp_path), 9)] == []


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    path, seen = f"file://{tmp_path}/r", []

    def run():
        def keep(df, _):
            seen.extend(_seen(df))

        q = spark.readStream.format("recording").load(path).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    first, second = _messages(100, 2), [(s, n + 1000, k, p) for s, n, k, p in _messages(80, 3)]
    _write(spark, first, path)
    run()
    assert sorted(seen) == sorted((a, b, c, bytes(x)) for a, b, c, x in first)
    _write(spark, second, path)
    run()
    assert sorted(seen) == sorted((a, b, c, bytes(x)) for a, b, c, x in first + second)


def _files(path):
    return {f"{os.path.basename(d)}/{f}" for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_changes_write_their_parts_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = keyed.KeyedTable(spark, path, "id", 8)
    table.create(spark.range(0, 200).selectExpr("id", "'a' as s", "cast(id as string) as t"))
    before = _files(path)
    table.upsert(spark.createDataFrame([(3, "b", None), (1000, "new", "x")], "id long, s string, t string"))
    kept = before & _files(path)
    assert len({f.split("/")[0] for f in before} - {f.split("/")[0] for f in kept}) in (1, 2)
    want = {k: ("a", str(k)) for k in range(200)} | {3: ("b", None), 1000: ("new", "x")}
    assert {r.id: (r.s, r.t) for r in table.rows().collect()} == want
    table.update_fields(spark.createDataFrame([(4, None), (9999, "z")], "id long, s string"), ["s"])
    table.delete(spark.createDataFrame([(5,), (5,), (77777,)], "id long"))
    want[4] = (None, "4")
    del want[5]
    assert {r.id: (r.s, r.t) for r in table.rows().collect()} == want
    assert [tuple(r) for r in table.get(4).collect()] == [(4, None, "4")] and table.get(5).collect() == []
    with pytest.raises(ValueError, match="more than once"):
        table.upsert(spark.createDataFrame([(1, "x", "y"), (1, "z", "y")], "id long, s string, t string"))
    table.upsert(spark.createDataFrame([], "id long, s string, t string"))
    assert {r.id: (r.s, r.t) for r in table.rows().collect()} == want


def test_delete_of_all_rows_of_a_part(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "id", 64)
    table.create(spark.range(0, 20).selectExpr("id", "1 as v"))
    table.delete(spark.createDataFrame([(7,)], "id long"))
    assert sorted(r.id for r in table.rows().collect()) == [k for k in range(20) if k != 7]


def test_killed_batch_counts_once(spark, tmp_path, monkeypatch):
    """The writer dies between a batch's data and its entry, and the query is started again."""
    book = ledger.Ledger(spark, f"file://{tmp_path}/l")
    rows = [(k, k % 3 if k % 10 else None, 0.5 + (k % 5) / 10) for k in range(90)]
    df = spark.createDataFrame(rows, "event_id long, interview_id long, confidence double")
    for part in range(3):
        df.where(f"event_id div 30 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    enter = ledger.Ledger._enter
    deaths = []

    def dying(self, batch):
        if batch == 1 and not deaths:
            deaths.append(batch)
            raise RuntimeError("killed")
        enter(self, batch)

    monkeypatch.setattr(ledger.Ledger, "_enter", dying)

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(ledger.strike_writer(book)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)

    with pytest.raises(Exception, match="killed"):
        run()
    assert book.entered() == [0] and (tmp_path / "l/data/batch=1").exists()
    run()
    assert book.entered() == [0, 1, 2] and deaths == [1]
    want = {}
    for _, i, c in rows:
        if i is not None and c >= 0.6:
            want[i] = want.get(i, 0) + 1
    assert {r.interview_id: r.strikes for r in ledger.strike_counts(book).collect()} == want
    ledger.strike_writer(book)(df, 2)  # a replay of an entered batch
    assert {r.interview_id: r.strikes for r in ledger.strike_counts(book).collect()} == want


def test_empty_ledger(spark, tmp_path):
    assert ledger.strike_counts(ledger.Ledger(spark, f"file://{tmp_path}/l")).collect() == []


def test_links_by_page():
    text = '<a href="https://GitHub.com/x">x</a>\f<p>no link\f<a name=q>q</a><A HREF=mailto:a@b.co>m</A>'
    assert links.links(text) == [("https://GitHub.com/x", "github", 1), ("mailto:a@b.co", "email", 3)]
    assert links.links('<a href="http://a.b">a</a>\f<a href="http://c.d') == []
    assert links.links(None) == links.links("") == []


def test_links_from_sql(spark):
    links.register(spark)
    docs = spark.createDataFrame([(1, '<a href="https://netflix.com">n</a>'), (2, None), (3, '<a href="x')], "id int, markup string")
    got = spark.sql("select id, url, type, page from {docs}, lateral document_links(markup)", docs=docs).collect()
    assert [tuple(r) for r in got] == [(1, "https://netflix.com", "twitter", 1)]


def test_details_of_any_shape(spark):
    texts = ['{"k":1}', '{"k":"2"}', '{"k":[3]}', '{"k":', None, "7", '{"k":"x"}', "{}"]
    rows = variants.parsed(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, details string"), "details")
    got = rows.orderBy("id").select("broken", variants.first_of(F.col("value"), ["$.k", "$.k[0]"], "int").alias("k")).collect()
    assert [tuple(r) for r in got] == [(False, 1), (False, 2), (False, 3), (True, None), (False, None), (False, None), (False, None), (False, None)]
    (shape,) = variants.shapes(rows.select(F.lit(1).alias("g"), "details"), "g", "details").collect()
    assert (shape.parsed, shape.broken, shape.shape) == (6, 1, "VARIANT")


def test_update_with_a_repeated_key_raises(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    with pytest.raises(Exception, match="more than once"):
        lifecycle.update_fields(rows, spark.createDataFrame([(1, "x"), (1, "y")], "id int, s string"), "id", ["s"]).collect()
