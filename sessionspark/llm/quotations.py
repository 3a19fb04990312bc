"""Quotation linking: reply-ordered conversations from messages that quote each other.

A line's quote level is the number of leading > signs (spaces between them are ignored). A run of lines of one level is a
passage; its paragraphs (parted by blank lines) and its lines are looked up where the whole passage is said nowhere. A
unit (passage, paragraph or line) is normalised (white space collapsed, lower case) and hashed with 128 bits. A message
holds the units of its own text: all of it, each run, paragraph and line. A hash's original is the first message of its
conversation that holds it, one row for each hash, so that a text said a thousand times is no hot group.

A message's parent is, of the originals that stand before it, that of the lowest quote level (a reply quotes its parent
at level 1; deeper levels count where level 1 has no original), there of the largest unit, and the latest of these. Root,
depth and the sizes of the reply trees follow by pointer doubling; position numbers a conversation depth first, replies of
one message and the roots by turn, so that ordering by it puts every message after what it answers and whole branches
together. The clean text has no quoted lines.

Defined cases: a null text is empty; units that are only white space are passed over; a message whose quotes have no
original before it in its conversation is a root; repeated (conversation, turn) rows share parent, root, depth and
position; a null conversation or turn links to nothing and has no position; a very long text is parsed whole; an empty
table gives an empty result; a kept column whose name is one of the result's gets a trailing underscore.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textio
from .running import LOW_BITS, before_buckets

PASSAGE, PARAGRAPH, LINE = 1, 2, 3
RESULT = ["parent_turn", "root_turn", "depth", "position", "n_quoted", "max_level", "clean_text"]

_MARKS = re.compile(r"((?:[ \t]*>)*)[ \t]?(.*)", re.S)


def units(lines: list[str]) -> dict[str, int]:
    """The normalised passage, paragraphs and lines of a run, each with its strongest kind."""
    normal = [" ".join(line.split()).lower() for line in lines]
    out = dict.fromkeys(normal, LINE)
    paragraph: list[str] = []
    for line in [*normal, ""]:
        if line:
            paragraph.append(line)
        elif paragraph:
            out[" ".join(paragraph)] = PARAGRAPH
            paragraph = []
    out[" ".join(filter(None, normal))] = PASSAGE
    out.pop("", None)
    return out


def parse(text: str | None) -> tuple[str, set[str], dict[tuple[int, str], int], int, int]:
    """Clean text, units held, units quoted (level, unit) with their kinds, number of quoted passages and highest level."""
    runs: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        level, rest = 0, line
        if line.lstrip(" \t")[:1] == ">":
            marks, rest = _MARKS.fullmatch(line).groups()
            level = marks.count(">")
        if runs and runs[-1][0] == level:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
    own = [line for level, lines in runs if not level for line in lines]
    held, said = set(units(own)), [r for r in runs if not r[0]]
    if len(said) > 1:
        held.update(u for _, lines in said for u in units(lines))
    quoted: dict[tuple[int, str], int] = {}
    for level, lines in runs:
        if level:
            for unit, kind in units(lines).items():
                quoted[(level, unit)] = min(kind, quoted.get((level, unit), LINE))
    return "\n".join(own).strip(" \t\n\r\x0b\x0c"), held, quoted, sum(level > 0 for level, _ in runs), max(level for level, _ in runs)


def _hashed(unit: str) -> bytes:
    return xxhash.xxh3_128_digest(unit.encode())


def _parsed(messages: DataFrame, conv: str, turn: str, text: str, keep: list[str]) -> DataFrame:
    """_keep (conv, turn and the kept columns), c, t, the facts of the text, and arrays of its units' hashes."""
    columns = [F.col(textio.quoted(c)) for c in (conv, turn, *keep)]
    rows = messages.select(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(columns))).alias("_keep"), columns[0].alias("c"), columns[1].cast("long").alias("t"), F.col(textio.quoted(text)).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:3], *T._parse_datatype_string("n_quoted int, max_level int, clean_text string, said array<binary>, levels array<int>, kinds array<int>, hashes array<binary>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textio.pieces(textio.utf8(batch.column(3))[1]):
                found = [parse(x) for x in batch.column(3).slice(i, j - i).to_pylist()]
                quoted = [sorted((level, kind, _hashed(u)) for (level, u), kind in f[2].items()) for f in found]
                listed = [
                    pa.array([f[3] for f in found], pa.int32()),
                    pa.array([f[4] for f in found], pa.int32()),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([sorted(map(_hashed, f[1])) for f in found], pa.list_(pa.binary())),
                    *(pa.array([[x[k] for x in q] for q in quoted], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))),
                ]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:3]), *listed], names=schema.names)

    return rows.mapInArrow(run, schema)


def _parents(parsed: DataFrame) -> DataFrame:
    """c, t and parent (null: none) of every message."""
    rows = parsed.where("c is not null and t is not null")
    originals = rows.select("c", "t", F.explode("said").alias("hash")).groupBy("c", "hash").agg(F.min("t").alias("original"))
    quotes = rows.where(F.size("hashes") > 0).select("c", "t", F.explode(F.arrays_zip("levels", "kinds", "hashes")).alias("q"))
    quotes = quotes.select("c", "t", F.col("q.levels").alias("level"), F.col("q.kinds").alias("kind"), F.col("q.hashes").alias("hash")).distinct()
    linked = quotes.join(originals, ["c", "hash"]).where("original < t").groupBy("c", "t").agg(F.max(F.struct(-F.col("level"), -F.col("kind"), "original"))["original"].alias("parent"))
    return rows.select("c", "t").distinct().join(linked, ["c", "t"], "left")


def _sizes(parents: DataFrame) -> tuple[DataFrame, str]:
    """parents with root, depth and size (messages of the branch, itself included), and the table's path.

    Pointer doubling: after k rounds top is the ancestor 2 ** k steps up, or the root, and size counts what is nearer than that.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    state = parents.select("c", "t", "parent", F.coalesce("parent", "t").alias("root"), F.when(F.col("parent").isNull(), none).otherwise(one).alias("depth"), one.alias("size"))
    state, path = textio.save(state, "replies")
    reach = 1
    while (live := state.where(F.col("depth") == reach)).limit(1).count():
        ends = state.select("c", F.col("t").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        moved = live.join(ends, ["c", "root"]).select("c", "t", "parent", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), "size")
        more = live.groupBy("c", F.col("root").alias("t")).agg(F.sum("size").alias("_more"))
        new = state.where(F.col("depth") != reach).unionByName(moved).join(more, ["c", "t"], "left")
        new, new_path = textio.save(new.withColumn("size", F.col("size") + F.coalesce("_more", none)).drop("_more"), "replies")
        textio.drop(parents.sparkSession, path)
        state, path, reach = new, new_path, 2 * reach
    return state, path


def _positions(sized: DataFrame) -> tuple[DataFrame, str]:
    """c, t and position (depth first), and the table's path: the sum of the steps from a parent (or the conversation's begin) along the way from the root."""
    group = ["c", "_parent", "_root"]
    rows = sized.select("c", "t", "parent", "size", F.coalesce("parent", F.lit(0)).alias("_parent"), F.col("parent").isNull().alias("_root"), F.shiftright("t", LOW_BITS).alias("_bucket"))
    within = F.sum("size").over(Window.partitionBy(*group, "_bucket").orderBy("t")) - F.col("size")
    rows = rows.withColumn("_within", within).join(before_buckets(rows, group, "_bucket", "size"), [*group, "_bucket"])
    step = F.col("before") + F.col("_within") + (~F.col("_root")).cast("long")
    state, path = textio.save(rows.select("c", "t", F.col("parent").alias("up"), step.alias("position")), "positions")
    while (live := state.where("up is not null")).limit(1).count():
        ends = state.select("c", F.col("t").alias("up"), F.col("up").alias("_up"), F.col("position").alias("_position"))
        moved = live.join(ends, ["c", "up"]).select("c", "t", F.col("_up").alias("up"), (F.col("position") + F.col("_position")).alias("position"))
        new, new_path = textio.save(state.where("up is null").unionByName(moved), "positions")
        textio.drop(sized.sparkSession, path)
        state, path = new, new_path
    return state.drop("up"), path


def link_quotations(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """conv, turn, keep, parent_turn, root_turn, depth, position, n_quoted, max_level and clean_text of every message."""
    spark = messages.sparkSession
    parsed, _ = textio.save(_parsed(messages, conv, turn, text, list(keep)), "messages")
    sized, sized_path = _sizes(_parents(parsed))
    placed, placed_path = _positions(sized)
    links, _ = textio.save(sized.join(placed, ["c", "t"]).select("c", "t", "parent", "root", "depth", "position"), "links")
    textio.drop(spark, sized_path, placed_path)
    joined = parsed.drop("said", "levels", "kinds", "hashes").join(links, ["c", "t"], "left")
    names = [conv, turn]
    for k in keep:
        while k in names or k in RESULT:
            k += "_"
        names.append(k)
    found = [F.col("parent").alias("parent_turn"), F.coalesce("root", "t").alias("root_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "position", "n_quoted", "max_level", "clean_text"]
    return joined.select(*(F.col(f"_keep.k{i}").alias(n) for i, n in enumerate(names)), *found)


def as_mail(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Messages as mail programs send them, as the table has none.

    Turns 0 and 1 of every four quote the message before, and the one that it quoted in turn; turn 2 its first line; turn 3
    all of it under a line of attribution, one level down.
    """
    texts = messages.where(F.col(text) != "").groupBy(F.col(conv).alias("_c"), F.col(turn).alias("_t")).agg(F.min(text).alias("_said"))
    out = messages
    for k in (1, 2):
        said = texts.select(F.col("_c").alias(f"_c{k}"), (F.col("_t") + k).alias(f"_t{k}"), F.col("_said").alias(f"_said{k}"))
        out = out.join(said, (F.col(conv) == F.col(f"_c{k}")) & (F.col(turn) == F.col(f"_t{k}")), "left")

    def marked(said, mark):
        return F.concat(F.lit(mark), F.replace(said, F.lit("\n"), F.lit(f"\n{mark}")), F.lit("\n"))

    style = F.pmod(turn, F.lit(4))
    head = F.when(style < 2, F.concat(F.coalesce(marked("_said2", ">> "), F.lit("")), marked("_said1", "> "))).when(style == 2, marked(F.get(F.split("_said1", "\n", 2), F.lit(0)), "> ")).otherwise(F.concat(F.lit("> wrote:\n"), marked("_said1", ">> ")))
    return out.select(*(F.concat(F.coalesce(head, F.lit("")), F.coalesce(text, F.lit(""))).alias(text) if c == text else c for c in messages.columns))


def op5_quotation_links(spark, sf_dir: str) -> DataFrame:
    mail = as_mail(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    linked = link_quotations(mail, keep=["role"])
    return linked.withColumn("clean_sha256", F.sha2(F.col("clean_text").cast("binary"), 256)).drop("clean_text")


_UNITS = r"""select {keys}, 1 as kind, text as u from {t} union all select {keys}, 2, unnest(string_split_regex(text, '\n\s*\n')) from {t} union all select {keys}, 3, unnest(string_split(text, chr(10))) from {t}"""
_NORMAL = r"trim(regexp_replace(lower(u), '\s+', ' ', 'g'))"
ORACLE = rf"""
with recursive m as (select conv_id, turn, role, coalesce(text, '') as text from conversations),
said as (select conv_id, turn, min(text) as text from m where text <> '' group by all),
originals as (select conv_id, unit, min(turn) as original from (select conv_id, turn, {_NORMAL} as unit from ({_UNITS.format(keys="conv_id, turn", t="m")})) where unit <> '' group by all),
ahead as (select conv_id, turn + 1 as turn, text, (turn + 1) % 4 as style from said),
sent as (select conv_id, turn, case when style = 3 then 2 else 1 end as level, case when style = 2 then string_split(text, chr(10))[1] else text end as text from ahead
 union all select conv_id, turn, 1, 'wrote:' from ahead where style = 3
 union all select s.conv_id, s.turn + 2, 2, s.text from said s join ahead a on a.conv_id = s.conv_id and a.turn = s.turn + 2 where a.style < 2),
quoted as (select conv_id, turn, level, kind, {_NORMAL} as unit from ({_UNITS.format(keys="conv_id, turn, level", t="sent")})),
parents as (select conv_id, turn, original as parent from (select *, row_number() over (partition by conv_id, turn order by level, kind, original desc) as k from quoted join originals using (conv_id, unit) where original < turn) where k = 1),
r as (select conv_id, turn, turn as here, 0::bigint as depth, [turn] as path from (select distinct conv_id, turn from m) union all select r.conv_id, r.turn, p.parent, r.depth + 1, list_prepend(p.parent, r.path) from r join parents p on r.conv_id = p.conv_id and r.here = p.turn),
up as (select conv_id, turn, arg_max(here, depth) as root_turn, max(depth) as depth, arg_max(path, depth) as path from r group by all),
placed as (select *, row_number() over (partition by conv_id order by path) - 1 as position from up),
facts as (select conv_id, turn, sum(n)::int as n_quoted, max(level)::int as max_level from (select conv_id, turn, level, 1 as n from sent) group by all)
select m.conv_id, m.turn, m.role, p.parent as parent_turn, root_turn, depth, position, coalesce(n_quoted, 0)::int as n_quoted, coalesce(max_level, 0)::int as max_level,
 sha256(regexp_replace(m.text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) as clean_sha256
from m join placed using (conv_id, turn) left join parents p on m.conv_id = p.conv_id and m.turn = p.turn left join facts f on m.conv_id = f.conv_id and m.turn = f.turn
"""
