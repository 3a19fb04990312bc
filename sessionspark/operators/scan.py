"""Ordered rules over one long session in many tasks: a segmented scan in three passes.

blocked() deals rows into ranges of (key, order) and numbers them, so that a session of any length is cut into blocks of at
most BLOCK rows. running() then has each block's own running values (a window over one block), one summary for each block, the
summaries of the blocks before it (a window over a session's blocks, BLOCK times fewer rows), and joins the two. It takes sums,
counts, greatest, least and last values: what is associative. Rules with a state are written with these (see below): the
playback clock is a max-plus pair, the strike stack a sum and its least value, the latch a count since the last change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .strikes import ORDER

#: Rows of a block, as a power of two.
BLOCK_BITS = 12


def blocked(rows: DataFrame, key: str, *order: str | Column, bits: int = BLOCK_BITS) -> DataFrame:
    """rows with _block and _at, which rise in the order of a key's rows; nulls come first. Written once, as later passes must see the same numbers.

    Rows that are equal in key and order are dealt out too, in no fixed order.
    """
    spread = F.xxhash64(*rows.columns)
    sorted_ = rows.repartitionByRange(F.col(key), *order, spread).sortWithinPartitions(F.col(key), *order, spread)
    return stored(sorted_.withColumn("_at", F.monotonically_increasing_id()), "blocks").withColumn("_block", F.shiftright("_at", bits))


_TOTAL = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _combined(kind: str, carry: Column, own: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0))
    if kind == "last":
        return F.coalesce(own, carry)
    return F.greatest(carry, own) if kind == "max" else F.least(carry, own)


def running(rows: DataFrame, key: str | list[str], values: dict[str, tuple[str, Column]], *, before: bool = False, at: str = "_at", block: str = "_block") -> DataFrame:
    """rows and, for each name, the running sum, count, max, min or last (nulls passed over) of a column within the key: up to each row, or of the rows before it."""
    keys = [key] if isinstance(key, str) else key
    held = rows
    for name, (_, value) in values.items():
        held = held.withColumn(f"_v_{name}", value)
    local = Window.partitionBy(*keys, block).orderBy(at).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    upper = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals, carries, own = [], [], []
    for name, (kind, _) in values.items():
        v, total = F.col(f"_v_{name}"), F.col(f"_t_{name}")
        if kind == "last":
            own.append(F.last(v, ignorenulls=True).over(local).alias(f"_o_{name}"))
            totals.append(F.max_by(v, F.when(v.isNotNull(), F.col(at))).alias(f"_t_{name}"))
            carries.append(F.last(total, ignorenulls=True).over(upper).alias(f"_c_{name}"))
        else:
            own.append(_TOTAL[kind](v).over(local).alias(f"_o_{name}"))
            totals.append(_TOTAL[kind](v).alias(f"_t_{name}"))
            carries.append((F.sum if kind == "count" else _TOTAL[kind])(total).over(upper).alias(f"_c_{name}"))
    sums = held.groupBy(*keys, block).agg(*totals)
    sums = sums.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(block).alias("_k_block"), *carries)
    on = F.col(block) == F.col("_k_block")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = held.select(*rows.columns, *own).join(sums, on)
    return out.select(*rows.columns, *(_combined(kind, F.col(f"_c_{name}"), F.col(f"_o_{name}")).alias(name) for name, (kind, _) in values.items()))


def without_marks(rows: DataFrame) -> DataFrame:
    return rows.drop("_at", "_block")


def playback(chunks: DataFrame) -> DataFrame:
    """turns.playback for sessions of any length: start = max(arrival, end of the one before)."""
    rows = running(blocked(chunks, "session", "seq"), "session", {"_before": ("sum", F.col("duration"))}, before=True)
    rows = running(rows, "session", {"_late": ("max", F.col("arrival") - F.col("_before"))})
    return without_marks(rows.withColumn("start", F.col("_before") + F.col("_late")).drop("_before", "_late"))


def stack_depth(ops: DataFrame) -> DataFrame:
    """strikes.stack_depth for interviews of any length: between resets, the sum of the steps less its least value so far, if that is below 0."""
    step = F.when(F.col("op") == "add", 1).when(F.col("op") == "pop", -1).otherwise(0)
    rows = running(blocked(ops, "interview_id", *ORDER), "interview_id", {"_epoch": ("sum", (F.col("op") == "reset").cast("int"))})
    rows = running(rows, ["interview_id", "_epoch"], {"_sum": ("sum", step)})
    rows = running(rows, ["interview_id", "_epoch"], {"_least": ("min", F.col("_sum"))})
    return without_marks(rows.withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.col("_least"))).drop("_sum", "_least", "_epoch"))


def latch(frames: DataFrame, on: int = 5, off: int = 12) -> DataFrame:
    """turns.latch for sessions of any length: the state turns at on speech frames (1) in a row, and back at off others (0 or null)."""
    speech = F.coalesce(F.col("speech") == 1, F.lit(False))
    rows = running(blocked(frames, "session", "frame_no"), "session", {"_n": ("count", F.lit(1))})
    rows = running(rows, "session", {"_spoke": ("max", F.when(speech, F.col("_n"))), "_still": ("max", F.when(~speech, F.col("_n")))})
    change = F.when(F.col("_n") - F.coalesce("_still", F.lit(0)) >= on, True).when(F.col("_n") - F.coalesce("_spoke", F.lit(0)) >= off, False)
    rows = running(rows.withColumn("_change", change), "session", {"_state": ("last", F.col("_change"))})
    return without_marks(rows.withColumn("speaking", F.coalesce("_state", F.lit(False))).drop("_n", "_spoke", "_still", "_change", "_state"))


def turns(speech: DataFrame, gap: int = 30) -> DataFrame:
    """turns.turns for sessions of any length: a new turn after more than gap frames without speech."""
    rows = running(blocked(speech, "session", "frame_no"), "session", {"_last": ("max", F.col("frame_no"))}, before=True)
    rows = rows.withColumn("_new", F.coalesce(F.col("frame_no") - F.col("_last") > gap, F.lit(True)).cast("int"))
    rows = running(rows, "session", {"turn": ("sum", F.col("_new"))})
    return without_marks(rows.drop("_new", "_last"))
