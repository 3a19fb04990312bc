"""The fixity audit against a plain comparison of records: faults among copies, null and huge ids, split files, high trees."""

import hashlib
import time
from collections import Counter

import pytest

from sessionspark.llm import merkle, textio

SCHEMA = "page_id long, url string, html string, file long, part long, digest string"  # the last three clash with the operator's own


def _pages(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, "x") for r in rows], SCHEMA)


def _record(page_id, url, html):
    body = (html or "").encode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _digest(*row):
    return hashlib.sha256(_record(*row)).hexdigest()


def _expected(primary, replica):
    """(page_id, digest, status) of every row of the report: equal digests first, then what is left by place."""
    out, keys = [], {(i, u or "") for i, u, _ in [*primary, *replica]}
    for key in keys:
        a, b = (Counter(_digest(i, u, h) for i, u, h in rows if (i, u or "") == key) for rows in (primary, replica))
        out += [(key[0], d, "intact") for d in (a & b).elements()]
        mine, other = sorted((a - b).elements()), sorted((b - a).elements())
        out += [(key[0], d, "corrupt" if k < len(other) else "missing") for k, d in enumerate(mine)]
        out += [(key[0], d, "extra") for d in other[len(mine) :]]
    return sorted(out, key=repr)


def _report(spark, primary, replica):
    rows = merkle.fixity_report(_pages(spark, primary), _pages(spark, replica)).collect()
    assert sorted(((r.page_id, r.record_sha256, r.status) for r in rows), key=repr) == _expected(primary, replica)
    return rows


BASE = [(k, f"u{k % 5}", f"text {k}") for k in range(40)] + [(k, "far", f"<p>{k}") for k in ((1 << 53) + 5, (1 << 62) + 1, -9, -(1 << 61))] + [(None, "none", "a"), (None, "none", "b"), (None, None, None), (3, "u3", "text 3"), (8, "long", "x" * 300_000)]


def test_null_and_huge_ids_in_a_damaged_replica(spark):
    began = time.time()
    spoilt = [(i, u, "#" + h if h and k % 3 == 0 else h) for k, (i, u, h) in enumerate(BASE) if k % 7 != 2] + [(None, "new", "n"), ((1 << 60) - 1, "new", "n")]
    rows = _report(spark, BASE, spoilt)
    assert {r.status for r in rows} == {"intact", "corrupt", "missing", "extra"}
    assert time.time() - began < 120


@pytest.mark.parametrize(("primary", "replica"), [(BASE, BASE), (BASE, []), ([], BASE), ([], []), (BASE[:1], [(BASE[0][0], BASE[0][1], None)])])
def test_whole_and_empty_replicas(spark, primary, replica):
    _report(spark, primary, replica)


def test_nodes_have_few_children_and_the_descent_reads_them(spark, monkeypatch):
    """Files are split, levels of parts and of files stand above each other, and no node has more children than it may."""
    monkeypatch.setattr(merkle, "FILE_RECORDS", 4)
    monkeypatch.setattr(merkle, "FILE_BITS", 1)
    monkeypatch.setattr(merkle, "RANGE_BYTES", 400)
    monkeypatch.setattr(merkle, "FAN_BITS", 2)
    monkeypatch.setattr(merkle, "FAN", 4)
    rows = [(None if k % 3 == 0 else k * 10, f"u{k}", "z" * (k % 90)) for k in range(120)] + [(5, "same", f"v{k}") for k in range(60)]
    layout = merkle.manifest([_pages(spark, rows)])
    (a,), steps = merkle.build([_pages(spark, rows)], layout)
    assert steps.count("part") >= 2 and steps.count("file") >= 3 and a.levels[-1].count() <= 4
    assert a.ranges.groupBy("file", "part").count().agg({"count": "max"}).first()[0] <= 16
    for below, step in zip(a.levels, steps, strict=False):
        up = below.selectExpr(*(f"shiftright({c}, {2 * (c == step)}) as {c}" for c in ("file", "part")))
        assert up.groupBy("file", "part").count().agg({"count": "max"}).first()[0] <= 4
    spoilt = [(i, u, "?" if k in (9, 50, 130) else h) for k, (i, u, h) in enumerate(rows) if k not in (12, 140)]
    bad = [r for r in _report(spark, rows, spoilt) if r.status != "intact"]
    assert sorted(r.status for r in bad) == ["corrupt"] * 3 + ["missing"] * 2


def test_the_plan_does_not_grow_with_the_tree(spark):
    def lines(rows):
        df = merkle.fixity_report(_pages(spark, rows), _pages(spark, [(i, u, h + "#") for i, u, h in rows]))
        text = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
        return text.count("\n")

    assert lines([(k << 26, "u", "a") for k in range(60)]) <= 1.2 * lines([(1, "u", "a")])


def test_a_repeated_record_is_one_row_and_its_last_copies_are_marked(spark, monkeypatch):
    monkeypatch.setattr("sessionspark.llm.running.CHUNK", 30)
    good = "x" * 2000
    rows = _report(spark, [(1, "u", good)] * 200, [(1, "u", good)] * 199 + [(1, "u", "spoilt")])
    bad = [r for r in rows if r.status != "intact"]
    assert len(bad) == 1 and bad[0].offset // merkle.RANGE_BYTES == 1 and bad[0].offset == max(r.offset for r in rows)
    assert len({r.offset for r in rows}) == 200
    (tree,), _ = merkle.build([_pages(spark, [(1, "u", good)] * 200)], merkle.manifest([_pages(spark, [(1, "u", good)])]))
    assert tree.records.count() == 1


def test_a_fault_in_one_of_differing_copies_names_its_digest(spark):
    htmls = [f"{k:02d}" + "y" * 3000 for k in range(150)]
    rows = [(1, "u", h) for h in htmls]
    for k in (0, 149):
        bad = [r for r in _report(spark, rows, [*rows[:k], (1, "u", "spoilt"), *rows[k + 1 :]]) if r.status != "intact"]
        assert [(r.record_sha256, r.status) for r in bad] == [(_digest(*rows[k]), "corrupt")]


def test_nodes_are_deleted_after_the_audit(spark):
    before = set(textio._written)
    merkle.fixity_report(_pages(spark, BASE), _pages(spark, BASE[1:]))
    assert len(set(textio._written) - before) <= 4  # the two parts of the manifest, the primary's records and the faults


@pytest.mark.parametrize("split", [False, True])
def test_a_flip_of_equal_length_makes_one_range_differ(spark, monkeypatch, split):
    monkeypatch.setattr(merkle, "RANGE_BYTES", 2000)
    if split:
        monkeypatch.setattr(merkle, "FILE_RECORDS", 100)
    rows = [(k, f"u{k}", f"{k:05d}" * 4) for k in range(700)]
    other = [(i, u, "#" + h[1:] if i == 345 else h) for i, u, h in rows]
    (a, b), _ = merkle.build([_pages(spark, rows), _pages(spark, other)], merkle.manifest([_pages(spark, rows), _pages(spark, other)]))
    assert (a.records.select("file", "part").distinct().count() > 1) == split
    both = a.ranges.selectExpr("file", "part", "range", "digest").exceptAll(b.ranges.select("file", "part", "range", "digest"))
    assert a.ranges.count() == b.ranges.count() > 30 and both.count() == 1


def test_a_replica_larger_than_the_primary_is_split_too(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FILE_RECORDS", 20)
    rows = [(None, "u", f"r{k}") for k in range(10)]
    more = rows + [(None, "u", f"s{k}") for k in range(300)] + [(None, f"v{k}", "t") for k in range(100)]
    (_, b), _ = merkle.build([_pages(spark, rows), _pages(spark, more)], merkle.manifest([_pages(spark, rows), _pages(spark, more)]))
    assert b.records.groupBy("file", "part").count().agg({"count": "max"}).first()[0] <= 60
    _report(spark, rows, more)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "u", "a", 2), (2, None, "b", 3)], "`page.id` long, `the url` string, `h.t` string, part int")
    assert sorted(r.status for r in merkle.fixity_report(df, df.where("part = 2"), key="page.id", url="the url", html="h.t").collect()) == ["intact", "missing"]
