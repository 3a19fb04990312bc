"""op11 against a forward search over all edits that keeps the least (cost, edits) of each state."""

import hashlib
import random
import zlib

import pytest

from sessionspark.llm import turnrepair

SPACES = " \t\n\x0b\x0c\r"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def _plain(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and hash of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, made) in list(best.items()):
                for role in ("user", "assistant"):
                    if (to := grammar.get((state, role[0]))) is not None:
                        new = (cost + 5, audit + "I", (*made, (role, "")))
                        best[to] = min(best.get(to, new), new)
        return best

    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, made) in inserted(best).items():
            found = [(state, (cost + 2, audit + "D", made))]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if (to := grammar.get((state, role[:1]))) is not None:
                    found.append((to, (cost + extra, audit + "K", (*made, (role, text)))))
                for other in ("user", "assistant"):
                    if (to := grammar.get((state, other[0]))) is not None:
                        found.append((to, (cost + 1 + extra, audit + "R", (*made, (other, text)))))
            for to, value in found:
                new[to] = min(new.get(to, value), value)
        best = new
    cost, audit, made = min(v for k, v in inserted(best).items() if k in ("", "a"))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def _expected(rows, dealt=None):
    groups = {r[0]: [] for r in rows}
    for conv, *row in _damaged(rows) if dealt is None else dealt:
        groups[conv].append(row)
    return sorted(((conv, *_plain(g)) for conv, g in groups.items()), key=repr)


def _got(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def _query(spark, tmp_path, rows, schema="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    return turnrepair.op11_turn_repair(spark, str(tmp_path))


def _rows(seed, convs, most, ties=False):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Why?", "and so", " ", "", None, "ok. \n", "long " * 9 + "end.", "é."])
            rows.append((c if c != 5 else None, rng.choice([None, 1, 2, 3]) if ties else t, role, text))
    return rows


@pytest.mark.parametrize("seed, ties", [(1, False), (2, True)])
def test_against_search(spark, tmp_path, seed, ties):
    rows = _rows(seed, 60, 9, ties)
    assert _got(_query(spark, tmp_path, rows)) == _expected(rows)


@pytest.mark.parametrize("chunk", [1, 2, 7])
def test_chunks_change_nothing(spark, tmp_path, monkeypatch, chunk):
    """Conversations that go over many chunks and ranges, one of them with a third of all rows."""
    monkeypatch.setattr(turnrepair, "CHUNK", chunk)
    rows = _rows(3, 20, 12) + [(99, t, r, x) for t, (_, _, r, x) in enumerate(_rows(4, 12, 20))]
    assert _got(_query(spark, tmp_path, rows)) == _expected(rows)


def test_rows_repeated_without_end(spark, tmp_path):
    rows = [(1, 0, "user", "Hi.")] * 3000 + [(1, 1, "assistant", "So.")] + [(2, 0, "user", "")] * 50
    assert _got(_query(spark, tmp_path, rows)) == _expected(rows)


def test_empty_long_and_clashing(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, chunk string, `a.b` int, copies int"
    long = "word " * 200_000 + "end."
    rows = [(1, 0, "user", long, "x", 1, 2), (1, 1, "assistant", long, "y", 1, 2), (2, None, None, None, None, None, None)]
    assert _got(_query(spark, tmp_path, rows, schema)) == _expected([r[:4] for r in rows])
    (tmp_path / "none").mkdir()
    assert _got(_query(spark, tmp_path / "none", [], schema)) == []


def test_on_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(turnrepair.op11_turn_repair(spark, folder)) == _expected(rows)


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "So."), (1, 1, "user", "Why?")], "conv_id long, turn long, role string, text string")
    (piece,) = turnrepair.repair(rows).collect()
    assert (piece["audit"], piece["cost"]) == ("RR", 2) and [tuple(t) for t in piece["repaired"]] == [("user", "So."), ("assistant", "Why?")]
