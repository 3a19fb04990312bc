"""Repair of conversations to the grammar (s?(ua)+)? by the cheapest edits.

A row may be kept (0), given the role user or assistant (1) or deleted (2); blank rows and repeats must be deleted, a truncated
row that stays costs 5 more, and a turn without text may be put in anywhere (5). Roles count by their first letters. State 0 is
the beginning, 1 after a system turn, 2 after a user's, 3 after an assistant's; a conversation may end in 0 and 3.

The cost to go of each state is found backward, row by row, and the edits are then read forward: from each row the ASCII-least
edit whose cost and cost to go add up. Rows are sorted into ranges and cut into chunks of at most CHUNK rows. A conversation
that lies in one chunk is done there. Of the others, each chunk's costs from any state to any state are a min-plus matrix; the
matrices are multiplied backward along the conversation to give the costs at each chunk's end, each chunk's walks from the four
states follow from them, and composed forward they give its first state. So no conversation is held whole, whatever its length;
only its audit, which is one string for each conversation, bounds it to 2 ** 31 edits.

Defined cases: a null role or text is one space, so such a row is blank or of a role that must change; turns are ordered by
turn (null first), then role and text; equal rows are counted before the shuffle and are one row with copies (all but the first
must be deleted); a null conv_id is a conversation; an empty table gives no rows; a very long text is a row of one chunk; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textio
from .digests import hash_pieces

#: Rows and bytes of text of a chunk; a row is never cut.
CHUNK, CHUNK_BYTES = 1024, 1 << 22
#: Costs of the edits, and what a truncated row that stays costs besides.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 60
END = (0, NEVER, NEVER, 0)
#: From each state: the next after a turn that the grammar takes there, and its role.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
LETTERS = {"s": 0, "u": 1, "a": 2}
#: The state after keeping a row of each letter (s, u, a, other); 9: the grammar doesn't take it.
KEPT = ((1, 2, 9, 9), (9, 2, 9, 9), (9, 9, 3, 9), (9, 2, 9, 9))


def backward(kinds: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs to go before each row and after the last: (rows + 1, states, ...) of rows of kinds, for the costs `after` (states, ...).

    A kind is the letter (0 to 3) plus 4 if the row must be deleted, plus 8 if it is truncated.
    """
    out = np.empty((len(kinds) + 1, *after.shape), np.int64)

    def inserted(c: np.ndarray) -> np.ndarray:
        return np.minimum(c, np.minimum(INSERT + c[list(NEXT)], 2 * INSERT + c[[3, 3, 2, 3]]))

    out[-1] = now = inserted(after)
    for i in range(len(kinds) - 1, -1, -1):
        kind = int(kinds[i])
        best = now + DELETE
        if not kind & 4:
            extra = TRUNCATED if kind & 8 else 0
            for s in range(4):
                keep = KEPT[s][kind & 3]
                if keep != 9:
                    best[s] = np.minimum(best[s], now[keep] + extra)
                best[s] = np.minimum(best[s], now[NEXT[s]] + REROLE + extra)
        out[i] = now = inserted(np.minimum(best, NEVER))
    return out


def forward(kinds: list[int], costs: list[list[int]], state: int, last: bool) -> tuple[str, list[str], int]:
    """(edits, roles, state): the ASCII-least edits on the way along the costs to go, the role of each turn that an edit leaves or puts in, and the state after the rows.

    Turns that are put in before a row belong to it; those behind the last row only where the conversation ends with it.
    """
    edits, roles = [], []
    for i, kind in enumerate(kinds):
        while True:
            now, after = costs[i][state], costs[i + 1]
            extra = TRUNCATED if kind & 8 else 0
            if now == after[state] + DELETE:
                edits.append("D")
                roles.append("")
                break
            if now == costs[i][NEXT[state]] + INSERT:
                edits.append("I")
                roles.append(ROLE[state])
                state = NEXT[state]
                continue
            keep = KEPT[state][kind & 3]
            if keep != 9 and not kind & 4 and now == after[keep] + extra:
                edits.append("K")
                roles.append("")
                state = keep
            else:
                edits.append("R")
                roles.append(ROLE[state])
                state = NEXT[state]
            break
    while last and costs[-1][state] != END[state]:
        edits.append("I")
        roles.append(ROLE[state])
        state = NEXT[state]
    return "".join(edits), roles, state


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_CHUNK = [
    ("chunk", "long"), ("whole", "boolean"), ("kinds", "binary"), ("copies", "array<long>"), ("roles", "array<string>"), ("texts", "array<string>"), ("matrix", "array<long>"),
    ("low", "long"), ("high", "long"), ("turns", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("first", "string"), ("last", "string"),
]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
LEGAL = {"su", "ua", "au"}


def _chunk(rows: list[tuple], place: int, whole: bool) -> tuple:
    """A chunk's row of _CHUNK from rows (turn, role, text, copies, blank, repeated, truncated)."""
    kinds, counts, illegal, before = bytearray(), [0, 0, 0], 0, None
    for _, role, _, n, blank, repeated, truncated in rows:
        kinds.append(LETTERS.get(role[:1], 3) + 4 * (blank or repeated) + 8 * (truncated and not blank and not repeated))
        counts[0] += n if blank else 0
        counts[1] += 0 if blank else n if repeated else n - 1
        counts[2] += truncated and not blank and not repeated
        illegal += n - 1 + (before is not None and before + role[:1] not in LEGAL)
        before = role[:1]
    turns = [r[0] for r in rows if r[0] is not None]
    # Costs from each state before the chunk to each after it; a whole conversation's end is known.
    matrix = None if whole else np.minimum(backward(np.frombuffer(bytes(kinds), np.uint8), np.where(np.eye(4, dtype=bool), 0, NEVER))[0], NEVER).ravel().tolist()
    different = 1 + sum(a != b for a, b in zip(turns, turns[1:])) if turns else 0
    return (
        place, whole, bytes(kinds), [r[3] for r in rows], [r[1] for r in rows], [r[2] for r in rows], matrix,
        turns[0] if turns else None, turns[-1] if turns else None, different, *counts, illegal, rows[0][1][:1], before,
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, made, kind = TaskContext.get().partitionId() << 33, 0, None
    now, rows, size, inside, seen = None, [], 0, False, False

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[]] * (len(_CHUNK) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *(_ARROW[t] for _, t in _CHUNK)], strict=True)], names=["conv", *(n for n, _ in _CHUNK)])

    for batch in batches:
        kind, out = batch.schema.field(0).type, []
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seen and (conv != now or len(rows) == CHUNK or size > CHUNK_BYTES):
                # A range's first conversation may have begun before it, and its last may go on behind it.
                out.append((now, *_chunk(rows, place + made, inside and conv != now)))
                made, rows, size, inside = made + 1, [], 0, conv != now
            now, seen = conv, True
            rows.append(row)
            size += len(row[2])
        yield batch_of(out)
    if seen:
        yield batch_of([(now, *_chunk(rows, place + made, False))])


def _after(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The costs to go at each chunk's end, of chunks from a conversation's last to its first."""
    now, costs = None, None
    for f in frames:
        out = []
        for conv, matrix in zip(f["group"], f["matrix"], strict=True):
            if costs is None or conv != now:
                now, costs = conv, np.array(END, np.int64)
                out.append((costs.tolist(), True))
            else:
                out.append((costs.tolist(), False))
            costs = np.minimum((np.asarray(matrix).reshape(4, 4) + costs[None, :]).min(axis=1), NEVER)
        yield pd.DataFrame({"chunk": f["chunk"], "after": [x[0] for x in out], "last": [x[1] for x in out]})


def _walks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state after a chunk for each state before it."""
    for f in frames:
        found = []
        for kinds, after, last in zip(f["kinds"], f["after"], f["last"], strict=True):
            costs = backward(np.frombuffer(kinds, np.uint8), np.asarray(after)).tolist()
            found.append([forward(list(kinds), costs, s, last)[2] if costs[0][s] < NEVER else 0 for s in range(4)])
        yield f[["group", "chunk"]].assign(walk=found)


def _states(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state before each chunk, of chunks in order."""
    now, state = None, None
    for f in frames:
        out = []
        for conv, walk in zip(f["group"], f["walk"], strict=True):
            if state is None or conv != now:
                now, state = conv, 0
            out.append(state)
            state = int(walk[state])
        yield pd.DataFrame({"chunk": f["chunk"], "state": out})


_FACTS = ["conv", "chunk", "whole", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last"]
_WALKED = ["kinds", "copies", "roles", "texts", "after", "ends", "state"]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The facts of chunks, and the cost, audit and turns of their repair."""
    for batch in batches:
        out, facts = [], len(_FACTS)
        for kinds, copies, roles, texts, after, last, state in zip(*(c.to_pylist() for c in batch.columns[facts:]), strict=True):
            costs = backward(np.frombuffer(kinds, np.uint8), np.array(END if after is None else after)).tolist()
            edits, new, end = forward(list(kinds), costs, state or 0, last is not False)
            turns, audit, i = [], [], 0
            for e, role in zip(edits, new, strict=True):
                if e == "I":
                    turns.append({"role": role, "text": ""})
                    audit.append(e)
                    continue
                if e != "D":
                    turns.append({"role": role or roles[i], "text": texts[i]})
                audit.append(e + "D" * (copies[i] - 1))
                i += 1
            spent = costs[0][state or 0] - (0 if last is not False else costs[-1][end]) + DELETE * (sum(copies) - len(copies))
            out.append((spent, "".join(audit), turns))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        found = [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.list_(_TURN)], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:facts], *found], names=[*_FACTS, "cost", "audit", "repaired"])


def repair(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations in pieces: conv, chunk (rises along a conversation), whole (the only piece), cost, audit, repaired (an array of role and text), and counts of the rows before."""
    space = F.lit(" ")
    held = rows.select(F.col(textio.quoted(conv)).alias("conv"), F.col(textio.quoted(turn)).cast("long").alias("turn"), *(F.coalesce(F.col(textio.quoted(c)), space).alias(n) for c, n in ((role, "role"), (text, "text"))))
    held = held.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    held = held.withColumn("_shown", F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1))
    # Where a conversation says the same at several turns, all but the first are repeats.
    said = held.where("_shown <> ''").groupBy("conv", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("a"), "turn")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    said = said.select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("text").alias("_text"), F.col("least.turn").alias("_turn"), F.lit(True).alias("_again"))
    on = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text"))
    repeated = F.coalesce(F.col("_again"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("_turn"))
    judged = held.join(said, on, "left").select("conv", "turn", "role", "text", "copies", (F.col("_shown") == "").alias("blank"), repeated.alias("repeated"), (~F.col("_shown").isin(".", "!", "?")).alias("truncated"))
    order = ["conv", "turn", "role", "text"]
    kind = judged.schema["conv"].dataType.simpleString()
    chunks = judged.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks, ", ".join([f"conv {kind}", *(f"{n} {t}" for n, t in _CHUNK)]))
    chunks, _ = textio.save(chunks, "chunks")
    # Conversations in several chunks, or at a range's border. The key is never null.
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("n")).alias("group")
    cut = chunks.where("not whole").select(key, "chunk", "matrix", "kinds")
    after = cut.select("group", "chunk", "matrix").repartition("group").sortWithinPartitions("group", F.desc("chunk")).mapInPandas(_after, "chunk long, after array<long>, last boolean")
    after, _ = textio.save(after, "after")
    walks = cut.select("group", "chunk", "kinds").join(after, "chunk").mapInPandas(_walks, "group string, chunk long, walk array<int>")
    states = walks.repartition("group").sortWithinPartitions("group", "chunk").mapInPandas(_states, "chunk long, state int")
    places, _ = textio.save(after.join(states, "chunk"), "places")
    found = chunks.join(places.withColumnRenamed("last", "ends"), "chunk", "left").select(*_FACTS, *_WALKED)
    schema = found.select(*_FACTS).schema.add("cost", "long").add("audit", "string").add("repaired", T.ArrayType(T.StructType().add("role", "string").add("text", "string")))
    return textio.save(found.mapInArrow(_repaired, schema), "repaired")[0]


def reports(pieces: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of repair()."""
    figures = ("blank", "duplicate", "truncated", "cost")
    part = F.struct("chunk", "low", "high", "turns", "first", "last", "illegal", "audit")
    grouped = pieces.groupBy("conv").agg(*(F.sum(c).alias(c) for c in figures), F.array_sort(F.collect_list(part)).alias("_parts"))
    zero = F.lit(0).cast("long")
    pairs = F.zip_with(F.slice("_parts", 1, F.size("_parts") - 1), F.slice("_parts", 2, F.size("_parts") - 1), lambda a, b: F.struct(a["high"].alias("a"), b["low"].alias("b"), F.concat(a["last"], b["first"]).alias("roles")))
    total = lambda field: F.aggregate("_parts", zero, lambda s, p: s + p[field])
    same = F.size(F.filter("_pairs", lambda p: p["a"] == p["b"]))
    wrong = F.size(F.filter("_pairs", lambda p: ~p["roles"].isin(*sorted(LEGAL))))
    span = F.array_max(F.transform("_parts", lambda p: p["high"])) - F.array_min(F.transform("_parts", lambda p: p["low"])) + 1
    out = grouped.withColumn("_pairs", pairs)
    return out.select(
        "conv", F.coalesce(span - (total("turns") - same), zero).alias("gaps"), "blank", "duplicate", "truncated", (total("illegal") + wrong).alias("illegal"), "cost", F.array_join(F.transform("_parts", lambda p: p["audit"]), "").alias("audit")
    )


def lines_sha256(pieces: DataFrame) -> DataFrame:
    """conv and sha256 of the repaired turns as role:text lines; conversations without turns are left out."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return hash_pieces(pieces.where(F.size("repaired") > 0).select("conv", F.col("chunk").alias("n"), "whole", lines.alias("piece")), ["conv"], "\n")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of conversations with the query's faults: by crc32 of conv_id:turn modulo 20, a row is dropped (0), emptied (1), left without .!? (2), repeated (3) or made the user's (4)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    held = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("_fault")).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    held = held.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_fault") == 3, 2).otherwise(1).alias("_times"))
    return held.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("conv_id", "turn", "role", "text")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    pieces = repair(damaged(rows))
    found = reports(pieces).withColumnRenamed("conv", "_conv")
    hashes = lines_sha256(pieces).withColumnRenamed("conv", "_hashed")
    ids = rows.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left")
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in figures), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
