"""Prefix tries of conversations by prefix-doubling naming.

Turns get dense names (equal role and text, one name). Block j, i is 2 ** j turns from i * 2 ** j on; its name is that of the
pair of its halves' names, so all blocks are named in as many rounds as the longest conversation has binary digits. The prefix
of d turns is the prefix without d's lowest bit and one block after it; prefixes are named from the highest bit down, in as
many rounds again. A node is a (depth, name); its conversation is the least of its members.

A conversation is the least member of a run of nodes at the end of its path: its branch, which hangs on a node of another. Sums
over subtrees are sums over branches, added up along the branches' links by pointer doubling, and running sums along a branch in
blocks. No step gathers a group: names are joined as one row for each pair of names, and sums are combined before the shuffle.

Defined cases: null role or text is empty; turns are ordered by turn (null first), then role and text, so rows that tie are
ordered by what they hold, and equal rows are turns of their own; rows without a conv_id belong to no conversation; an empty
table has no nodes; a very long text is read once, to name it; a conversation may have any number of turns; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import blocked, running
from . import textio
from .digests import sha256_joined

#: Nodes of a branch that one window takes, as a power of two.
BLOCK_BITS = 12


def dense_names(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and name: 0, 1, ... for the different values of keys, a row for each."""
    spark = rows.sparkSession
    found, _ = textio.save(rows.select(*keys).distinct().withColumn("_id", F.monotonically_increasing_id()), "names")
    # One row for each partition that wrote names, on the driver.
    parts = sorted(found.groupBy(F.shiftright("_id", 33).alias("part")).count().collect())
    starts, n = [], 0
    for part, count in parts:
        starts.append((part, n))
        n += count
    starts = spark.createDataFrame(starts, "_part long, _start long")
    named = found.join(F.broadcast(starts), F.shiftright("_id", 33) == F.col("_part"))
    return named.select(*keys, (F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def numbered_turns(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, texts): conv, pos (from 0) and name of every turn; name, role and text of every different one."""
    held = rows.where(F.col(textio.quoted(conv)).isNotNull()).select(
        F.col(textio.quoted(conv)).alias("conv"), F.col(textio.quoted(turn)).alias("turn"), *(F.coalesce(F.col(textio.quoted(c)), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text")))
    )
    placed = running(blocked(held, "conv", "turn", "role", "text"), "conv", {"pos": ("count", F.lit(1))}, before=True)
    texts, _ = textio.save(dense_names(placed, ["role", "text"], "name"), "texts")
    turns, _ = textio.save(placed.join(texts, ["role", "text"]).select("conv", "pos", "name"), "turns")
    return turns, texts


def prefix_names(turns: DataFrame) -> DataFrame:
    """conv, d and name of every prefix of d turns, d from 1 on, of conversations of turns (conv, pos, name): equal d and name, equal turns."""
    levels = [turns.select("conv", F.col("pos").alias("i"), "name")]
    most = turns.agg(F.max("pos")).first()[0]
    if most is None:
        return turns.select("conv", F.col("pos").alias("d"), "name")
    for _ in range((most + 1).bit_length() - 1):
        odd = F.col("i") % 2 == 1
        halves = levels[-1].groupBy("conv", F.shiftright("i", 1).alias("i")).agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b")).where("b is not null")
        names = dense_names(halves, ["a", "b"], "name")
        levels.append(textio.save(halves.join(names, ["a", "b"]).select("conv", "i", "name"), "blocks")[0])
    found: DataFrame | None = None
    for j in range(len(levels) - 1, -1, -1):
        # Odd multiples of 2 ** j: one block, or a prefix whose length has no lower bits and a block.
        blocks = levels[j].select("conv", "name", (F.col("i") * (1 << j)).alias("before"), ((F.col("i") + 1) * (1 << j)).alias("d")).where(F.col("i") % 2 == 0)
        here = blocks.where("before = 0").select("conv", "d", "name")
        if found is not None:
            pairs = blocks.where("before > 0").join(found.select("conv", F.col("d").alias("before"), F.col("name").alias("a")), ["conv", "before"]).select("conv", "d", "a", F.col("name").alias("b"))
            pairs, _ = textio.save(pairs, "pairs")
            here = here.unionByName(pairs.join(dense_names(pairs, ["d", "a", "b"], "name"), ["d", "a", "b"]).select("conv", "d", "name"))
            here = found.unionByName(textio.save(here, "prefixes")[0])
        else:
            here, _ = textio.save(here, "prefixes")
        found = here
    return found


def _links(branches: DataFrame) -> DataFrame:
    """owner, leaves and saved, added up over all branches that hang on the owner's (owner, up, leaves, saved), by pointer doubling."""
    held, _ = textio.save(branches.select("owner", F.col("up").alias("jump"), "leaves", "saved"), "links")
    while held.where("jump is not null").limit(1).count():
        # A branch has the sums of those less than 2 ** k links below it, and a link to the one 2 ** k above.
        more = held.where("jump is not null").groupBy(F.col("jump").alias("owner")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        far = held.select(F.col("owner").alias("jump"), F.col("jump").alias("_far"))
        out = held.join(far, "jump", "left").join(more, "owner", "left")
        zero = F.lit(0).cast("long")
        held, _ = textio.save(out.select("owner", F.col("_far").alias("jump"), (F.col("leaves") + F.coalesce("_l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("_s", zero)).alias("saved")), "links")
    return held.drop("jump")


def prefix_trie(turns: DataFrame, texts: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): every node of the trie of conversations (convs: conv, size; turns: conv, pos, name), and the node, as (owner, d), at which each conversation ends."""
    zero = F.lit(0).cast("long")
    prefixes = prefix_names(turns).unionByName(convs.select("conv", zero.alias("d"), zero.alias("name")))
    nodes, _ = textio.save(prefixes.groupBy("d", "name").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs")), "nodes")
    # The last turn's length, from the owner's own turn.
    lengths = texts.select("name", F.char_length("text").cast("long").alias("length"))
    last = turns.select(F.col("conv").alias("owner"), (F.col("pos") + 1).alias("d"), "name").join(nodes.select("owner", "d"), ["owner", "d"]).join(lengths, "name").select("owner", "d", "length")
    weights = nodes.join(last, ["owner", "d"], "left").select("owner", "d", "n_convs", ((F.col("n_convs") - 1) * F.coalesce("length", zero)).alias("weight"))
    weights, _ = textio.save(weights, "weights")
    # Branches: the nodes of one owner, from depth lo to hi, below a node of up.
    branches = weights.groupBy("owner").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("weight").alias("saved"))
    above = branches.where("lo > 0").select("owner", (F.col("lo") - 1).alias("d")).join(prefixes.withColumnRenamed("conv", "owner"), ["owner", "d"])
    above = above.join(nodes.select("d", "name", F.col("owner").alias("up")), ["d", "name"]).select("owner", "up", F.col("d").alias("up_d"))
    branches, _ = textio.save(branches.join(above, "owner", "left"), "branches")
    hung = branches.where("up is not null").groupBy(F.col("up").alias("owner"), F.col("up_d").alias("d")).agg(F.count(F.lit(1)).alias("n_hung"))
    tops = branches.join(hung, (branches["owner"] == hung["owner"]) & (branches["hi"] == hung["d"]), "left").select(branches["owner"], "up", F.when(F.col("n_hung").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved")
    totals, _ = textio.save(_links(tops), "totals")
    below = branches.where("up is not null").select("owner", F.col("up"), F.col("up_d")).join(totals, "owner")
    below = below.groupBy(F.col("up").alias("owner"), F.col("up_d").alias("d")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"), F.count(F.lit(1)).alias("_n"))
    rows = weights.join(below, ["owner", "d"], "left").join(branches.select("owner", "lo", "hi", "up"), "owner")
    own_leaf = (F.col("d") == F.col("hi")) & F.col("_n").isNull()
    rows = rows.withColumn("_leaf", F.when(own_leaf, 1).otherwise(0) + F.coalesce("_l", zero)).withColumn("_saved", F.col("weight") + F.coalesce("_s", zero)).withColumn("_b", F.shiftright("d", BLOCK_BITS))
    # What the subtree has is what the branch has in all, less what hangs on its nodes before this one.
    rows = running(rows, "owner", {"_l0": ("sum", F.col("_leaf")), "_s0": ("sum", F.col("_saved"))}, before=True, at="d", block="_b").join(totals.select("owner", F.col("leaves").alias("_l1"), F.col("saved").alias("_s1")), "owner")
    parent = F.when(F.col("d") > F.col("lo"), F.col("owner")).otherwise(F.col("up"))
    children = F.coalesce("_n", zero) + F.when(F.col("d") < F.col("hi"), 1).otherwise(0)
    out = rows.select("owner", "d", parent.alias("parent"), "n_convs", children.cast("long").alias("n_children"), (F.col("_l1") - F.col("_l0")).alias("n_leaves"), (F.col("_s1") - F.col("_s0")).alias("saved_tokens"))
    ends = convs.select("conv", F.col("size").alias("d")).join(prefixes, ["conv", "d"]).join(nodes.select("d", "name", "owner"), ["d", "name"]).select("conv", "owner", "d")
    return out, ends


def _head(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")


def shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) as the query rebuilds them: the first h turns of conversation c - c % 100, then c's own after its first h, h = crc32(c) % 6."""
    convs, _ = textio.save(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")), "convs")
    wanted = convs.select("conv", _head(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base"))
    sizes = convs.select(F.col("conv").alias("base"), F.col("own").alias("_base"))
    wanted = wanted.join(sizes, "base", "left").select("conv", "base", "h", F.least(F.col("h"), F.coalesce("_base", F.lit(0))).cast("long").alias("m"))
    # A conversation's first turns are few, whatever its length.
    first = turns.where("pos < 5").select(F.col("conv").alias("base"), "pos", "name")
    heads = wanted.where("m > 0").join(first, "base").where("pos < m").select("conv", "pos", "name")
    own = turns.where(F.col("pos") >= _head(F.col("conv"))).join(wanted.select("conv", "m"), "conv").select("conv", (F.col("pos") - _head(F.col("conv")) + F.col("m")).alias("pos"), "name")
    rebuilt, _ = textio.save(heads.unionByName(own), "rebuilt")
    sized = convs.join(wanted.select("conv", "h", "m"), "conv").select("conv", (F.col("m") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("h"))).alias("size"))
    return rebuilt, textio.save(sized, "sized")[0]


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, texts = numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    rebuilt, convs = shared_heads(turns)
    nodes, ends = prefix_trie(rebuilt, texts, convs)
    hashes = sha256_joined(ends.withColumn("listed", F.col("conv").cast("string")), ["owner", "d"], ["conv"], "listed", ",")
    out = nodes.join(hashes, ["owner", "d"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of an ASCII string: one step for each bit, the least of a byte first."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_transform(range(8), lambda k: (ascii(ch)::bigint >> k::bigint) & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295::bigint)"


ORACLE = f"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as p, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} as v from conversations where conv_id is not null),
o as (select c, list(v order by p) as v from t group by c),
h as (select c, v, {_crc32("c::varchar")} % 6 as h, c - c % 100 as b from o),
r as (select h.c, coalesce(o.v, [])[1:h.h] || h.v[h.h + 1:] as v from h left join o on o.c = h.b),
p as (select c, len(v) = d as at_end, d, v[1:d] as s from (select c, v, unnest(range(0, len(v) + 1)) as d from r)),
n as (select d, s, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(c::varchar, ',' order by c) filter (at_end), '') as ends from p group by d, s),
k as (select d - 1 as d, s[1:d - 1] as s, count(*) as n_children from n where d > 0 group by 1, 2),
w as (select n.*, coalesce(n_children, 0) as n_children, case when d > 0 then (n_convs - 1) * length(s[d].x) else 0 end as w from n left join k using (d, s)),
u as (select up as d, s[1:up] as s, count(*) filter (n_children = 0) as n_leaves, sum(w)::bigint as saved_tokens from (select *, unnest(range(0, d + 1)) as up from w) group by 1, 2)
select w.conv_id::bigint as conv_id, w.d::bigint as depth, q.conv_id::bigint as parent_conv_id, w.n_convs::bigint as n_convs, w.n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens, sha256(w.ends) as ends_sha256
from w join u using (d, s) left join n q on q.d = w.d - 1 and q.s = w.s[1:w.d - 1]
"""
