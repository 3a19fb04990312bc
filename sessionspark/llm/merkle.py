"""Merkle fixity audit of WARC replicas.

Records are laid out in files of 2 ** FILE_BITS consecutive ids, ordered by id, url and digest; equal records are one row
with a count of copies. The replicas' common layout (the manifest) splits a file whose ids hold more than FILE_RECORDS rows in
either of them into parts by a hash of id and url; only where one id and url has more than FILE_RECORDS rows are they dealt by
their digest too. So a record that changes at equal length stays in its place, and exactly one range differs. A leaf is the SHA-256 of a record. Records whose offsets begin in the same
RANGE_BYTES of a part make a range node, ranges a part's node; FAN parts of a file and then FAN files make a node of the
next level, up to a level of at most FAN nodes under the root. So every node has few children whatever ids there are. A
node's digest is that of its children's positions and digests in order, so trees of replicas are built apart and compared
from the root; each level's differing nodes are written before the next level is read, and only children of nodes that
differ are compared. Records of differing ranges are then matched by id, url and digest, what is left over by id, url and
place among the left-over copies; the primary's range and offset tell which record it is.

Defined cases: a null url or html is empty in its record; null ids have a file of their own, after all others; of equal
records the last copies are the ones that a fault marks; very long records are leaves as any other; two empty replicas
have equal roots; an empty replica lacks all records; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textio
from .running import each_copy

FILE_BITS, FILE_RECORDS, RANGE_BYTES, FAN_BITS = 10, 4096, 1 << 18, 4
FAN = 1 << FAN_BITS
#: The file of null ids: no 64-bit id has so large a file number.
NO_ID = 1 << 60
#: Copies of the manifest, so that the records of one split file are joined in several tasks.
SALTS = 16

RECORD, NODE = ["file", "id", "url", "digest"], ["file", "part"]


def warc_record(key: str, url: str, html: str | Column) -> Column:
    """A WARC/1.1 response record."""
    body = F.coalesce(F.col(textio.quoted(html)) if isinstance(html, str) else html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(textio.quoted(key)).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(F.col(textio.quoted(url)), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _file(key: str) -> Column:
    return F.coalesce(F.shiftright(F.col(textio.quoted(key)).cast("long"), FILE_BITS), F.lit(NO_ID))


def _most(pages: list[DataFrame], by: list[Column]) -> DataFrame:
    """by and n, the rows of the replica that has most of them."""
    counts = None
    for p in pages:
        c = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        counts = c if counts is None else counts.unionByName(c)
    return counts.groupBy(*(c for c in counts.columns if c != "n")).agg(F.max("n").alias("n"))


def manifest(pages: list[DataFrame], key: str = "page_id", url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(files that are split, and into how many parts; ids and urls that have more rows than a part): each at most a row for FILE_RECORDS rows of a replica."""
    files = _most(pages, [_file(key).alias("file")]).select("file", F.ceil(F.col("n") / FILE_RECORDS).cast("long").alias("parts")).where("parts > 1")
    names = [F.col(textio.quoted(key)).cast("long").alias("_id"), F.coalesce(F.col(textio.quoted(url)), F.lit("")).alias("_url")]
    many = _most(pages, names).where(F.col("n") > FILE_RECORDS).select("_id", "_url", F.lit(True).alias("_many"))
    return textio.save(files, "manifest")[0], textio.save(many, "many")[0]


class Tree:
    """A replica's records, ranges and levels of nodes (file, part, digest), written to the shared folder."""

    def __init__(self, pages: DataFrame, layout: tuple[DataFrame, DataFrame], *, key: str = "page_id", url: str = "url", html: str = "html") -> None:
        self.spark, self.paths = pages.sparkSession, []
        rows = pages.select(F.col(textio.quoted(key)).cast("long").alias("id"), F.coalesce(F.col(textio.quoted(url)), F.lit("")).alias("url"), warc_record(key, url, html).alias("record"), _file(key).alias("file"))
        rows = rows.select("file", "id", "url", F.octet_length("record").cast("long").alias("n_bytes"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))
        rows = rows.groupBy(*RECORD).agg(F.first("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("copies"))
        files, many = layout
        rows = rows.join(many, F.col("id").eqNullSafe(F.col("_id")) & (F.col("url") == F.col("_url")), "left").drop("_id", "_url")
        rows = rows.withColumn("_hash", F.when(F.col("_many"), F.xxhash64("id", "url", "digest")).otherwise(F.xxhash64("id", "url"))).drop("_many").withColumn("_salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)))
        salted = files.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.join(salted, ["file", "_salt"], "left").withColumn("part", F.coalesce(F.pmod("_hash", "parts"), F.lit(0).cast("long"))).drop("parts", "_salt", "_hash")
        order = Window.partitionBy(*NODE).orderBy("id", "url", "digest").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("offset", F.coalesce(F.sum(F.col("n_bytes") * F.col("copies")).over(order), F.lit(0).cast("long")))
        self.records, self.records_path = textio.save(rows.withColumn("range", F.floor(F.col("offset") / RANGE_BYTES).cast("long")), "records")
        self.ranges = self._save(_above(self.records, [*NODE, "range"], ["offset", "copies"]))
        self.levels = [self._save(_above(self.ranges, NODE, ["range"]))]

    def _save(self, nodes: DataFrame) -> DataFrame:
        out, path = textio.save(nodes, "nodes")
        self.paths.append(path)
        return out

    def raise_level(self, step: str) -> None:
        """Add a level above the last one, with nodes of FAN neighbouring parts or files (step)."""
        below = self.levels[-1].withColumn("_place", F.col(step)).withColumn(step, F.shiftright(step, FAN_BITS))
        self.levels.append(self._save(_above(below, NODE, ["_place"])))

    def root(self) -> str:
        """The digest of the top level, which has at most FAN nodes."""
        top = sorted(self.levels[-1].select(*NODE, "digest").collect())
        return hashlib.sha256("\n".join(f"{r.file}:{r.part}:{r.digest}" for r in top).encode()).hexdigest()

    def drop_nodes(self) -> None:
        textio.drop(self.spark, *self.paths)


def _above(children: DataFrame, by: list[str], place: list[str]) -> DataFrame:
    """Nodes over children: the digest of their places and digests in order."""
    listed = F.array_sort(F.collect_list(F.struct(*place, "digest")))
    text = F.array_join(F.transform(listed, lambda c: F.concat_ws(":", *(c[p].cast("string") for p in place), c["digest"])), "\n")
    return children.groupBy(*by).agg(F.sha2(text.cast("binary"), 256).alias("digest"))


def build(pages: list[DataFrame], layout: tuple[DataFrame, DataFrame], **columns) -> tuple[list[Tree], list[str]]:
    """Trees of replicas (the primary first) of equal height, and the steps of their levels."""
    trees = [Tree(p, layout, **columns) for p in pages]
    most = layout[0].agg(F.max("parts")).first()[0] or 1
    steps = ["part"] * (-(-(most - 1).bit_length() // FAN_BITS))
    for step in steps:
        for t in trees:
            t.raise_level(step)
    while any(t.levels[-1].count() > FAN for t in trees):
        steps.append("file")
        for t in trees:
            t.raise_level("file")
    return trees, steps


def _differing(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    both = a.select(*by, "digest").join(b.select(*by, F.col("digest").alias("_digest")), by, "full")
    return both.where(~F.col("digest").eqNullSafe(F.col("_digest"))).select(*by)


def audit(primary: Tree, replica: Tree, steps: list[str]) -> DataFrame:
    """file, part, id, url, place, range and offset (the primary's; null, if extra), n_bytes, digest, other_digest and status (corrupt, missing, extra) of each copy of a record that differs."""
    trees, written = (primary, replica), []

    def kept(df: DataFrame) -> DataFrame:
        out, path = textio.save(df, "differing")
        written.append(path)
        return out

    bad = kept(_differing(*(t.levels[-1] for t in trees), NODE))
    for k in range(len(steps) - 1, -1, -1):
        other = "file" if steps[k] == "part" else "part"
        over = bad.select(F.col(steps[k]).alias("_up"), other)
        bad = kept(_differing(*(t.levels[k].withColumn("_up", F.shiftright(steps[k], FAN_BITS)).join(over, ["_up", other], "left_semi") for t in trees), NODE))
    bad = kept(_differing(*(t.ranges.join(bad, NODE, "left_semi") for t in trees), [*NODE, "range"]))
    zero = F.lit(0).cast("long")
    a, b = (t.records.join(bad, [*NODE, "range"], "left_semi") for t in trees)
    both = a.select(*RECORD, "part", "offset", "n_bytes", F.col("copies").alias("mine"), zero.alias("other")).unionByName(b.select(*RECORD, F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("offset"), "n_bytes", zero.alias("mine"), F.col("copies").alias("other")))
    both = both.groupBy(*RECORD).agg(F.max("part").alias("part"), F.max("offset").alias("offset"), F.max("n_bytes").alias("n_bytes"), F.sum("mine").alias("mine"), F.sum("other").alias("other"))
    key = ["file", "id", "url"]
    left = both.where("mine <> other").withColumn("side", (F.col("mine") < F.col("other")).cast("int")).withColumn("n", F.abs(F.col("mine") - F.col("other")))
    left = kept(left.withColumn("start", F.sum("n").over(Window.partitionBy(*key, "side").orderBy("digest")) - F.col("n")))
    each = each_copy(left, "n", ["id", "url", "digest"]).withColumn("place", F.col("start") + F.col("copy"))
    each = each.withColumn("offset", F.col("offset") + (F.col("mine") - F.col("n") + F.col("copy")) * F.col("n_bytes"))  # the last copies
    own = {c: F.max(F.when(F.col("side") == 0, F.col(c))).alias(c) for c in ("part", "offset", "n_bytes", "digest")}
    pairs = each.groupBy(*key, "place").agg(*own.values(), F.max(F.when(F.col("side") == 1, F.col("digest"))).alias("other_digest"))
    status = F.when(F.col("other_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
    out, _ = textio.save(pairs.withColumn("range", F.floor(F.col("offset") / RANGE_BYTES).cast("long")).withColumn("status", status), "faults")
    textio.drop(primary.spark, *written)
    return out


def fixity_report(primary: DataFrame, replica: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every record of the primary with file, part, offset (in its part of the file), n_bytes, record_sha256 and status, and the replica's extra ones."""
    (a, b), steps = build([primary, replica], manifest([primary, replica], key, url), key=key, url=url, html=html)
    same = a.root() == b.root()
    bad = None if same else audit(a, b, steps)
    for t in (a, b):
        t.drop_nodes()
    textio.drop(a.spark, b.records_path)
    copies = each_copy(a.records, "copies", ["id", "url", "digest"]).withColumn("offset", F.col("offset") + F.col("copy") * F.col("n_bytes"))
    if same:
        found = copies.withColumn("status", F.lit("intact"))
    else:
        marks = bad.where("status <> 'extra'").select(*NODE, "offset", "status")
        found = copies.join(marks, [*NODE, "offset"], "left").withColumn("status", F.coalesce("status", F.lit("intact")))
    found = found.select(F.col("id").alias(key), "file", "part", "offset", "n_bytes", F.col("digest").alias("record_sha256"), "status")
    if same:
        return found
    none = F.lit(None).cast("long")
    return found.unionByName(bad.where("status = 'extra'").select(F.col("id").alias(key), "file", none.alias("part"), none.alias("offset"), none.alias("n_bytes"), F.col("other_digest").alias("record_sha256"), "status"))


def damaged(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A replica with known faults, as the tables have none: of every 101 ids one has its first character changed, of 757 one
    lacks half its text, of 499 one is missing, and of 997 one is there a second time under another url."""
    k = F.pmod(F.col(key), F.lit(101)), F.pmod(F.col(key), F.lit(757)), F.pmod(F.col(key), F.lit(499)), F.pmod(F.col(key), F.lit(997))
    body = F.when(k[0] == 7, F.concat(F.lit("#"), F.substring(html, 2, 1 << 30))).when(k[1] == 13, F.expr(f"left({html}, cast(length({html}) / 2 as int))")).otherwise(F.col(html))
    kept = pages.where((k[2] != 11) | F.col(key).isNull()).withColumn(html, body)
    again = pages.where(k[3] == 17).withColumn("url", F.concat(F.coalesce("url", F.lit("")), F.lit("#copy")))
    return kept.unionByName(again)


def op2_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return fixity_report(pages, damaged(pages))


_RECORD = r"""'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '') || '>' || chr(13) || chr(10)
 || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::varchar || chr(13) || chr(10) || chr(13) || chr(10)
 || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""
ORACLE = f"""
with a as (select page_id, url, {_RECORD} as rec, floor(page_id / 1024)::bigint as file from pages),
ad as (select page_id, coalesce(url, '') as url, file, strlen(rec)::bigint as n_bytes, sha256(rec) as digest from a),
ao as (select *, coalesce(sum(n_bytes) over (partition by file order by page_id, url, digest rows between unbounded preceding and 1 preceding), 0)::bigint as "offset",
  row_number() over (partition by page_id, url order by digest) as place from ad),
b0 as (select page_id, url, case when page_id % 101 = 7 then '#' || substring(html, 2) when page_id % 757 = 13 then left(html, (length(html) // 2)::int) else html end as html from pages where page_id % 499 <> 11
  union all select page_id, coalesce(url, '') || '#copy', html from pages where page_id % 997 = 17),
b as (select page_id, coalesce(url, '') as url, sha256({_RECORD}) as other, floor(page_id / 1024)::bigint as file from b0),
bo as (select *, row_number() over (partition by page_id, url order by other) as place from b)
select coalesce(ao.page_id, bo.page_id) as page_id, coalesce(ao.file, bo.file) as file, case when ao.file is not null then 0::bigint end as part, ao."offset", ao.n_bytes, coalesce(digest, other) as record_sha256,
  case when other is null then 'missing' when digest is null then 'extra' when digest = other then 'intact' else 'corrupt' end as status
from ao full join bo on ao.page_id = bo.page_id and ao.url = bo.url and ao.place = bo.place
"""
