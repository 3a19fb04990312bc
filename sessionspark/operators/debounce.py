"""The no-face debounce without a pass over the rows in order: a successor graph and reachability by pointer doubling.

A sample without a face is reported if the last sample with one face, or the last report, is more than `quiet` ms before it. So
after a report the next one is the first such sample that is more than `quiet` later: each sample without a face has one
successor, whatever came before it. Samples more than `quiet` after the sample without a face (or with one) before them are
reported in any case; between two of these, the reports are what can be reached from the first by successors. That is found in as
many rounds as the longest such chain has binary digits, and in none where samples are further apart than `quiet`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored


def successors(rows: DataFrame, quiet: int) -> DataFrame:
    """event_id, session, _start (starts the clock), _sure (reported in any case) and after (the successor's event_id, null at a chain's end) of samples with one face or none."""
    order = Window.partitionBy("session").orderBy("ts", "event_id")
    now = F.unix_millis(F.col("ts").cast("timestamp"))
    held = rows.where(F.col("session").isNotNull()).select("event_id", "session", "ts", now.alias("now"), "faces", F.row_number().over(order).alias("_k"))
    # The clock starts at a session's first sample and at each one with a face.
    start = (F.col("_k") == 1) | F.coalesce(F.col("faces") == 1, F.lit(False))
    held = held.withColumn("_start", start).withColumn("_part", F.count_if("_start").over(order))
    seen = held.where(F.col("_start") | (F.col("faces") == 0))
    part = Window.partitionBy("session", "_part").orderBy(F.desc("_start"), "ts", "event_id")
    gap = F.col("now") - F.lag("now").over(part)
    seen = seen.withColumn("_sure", F.coalesce(gap > quiet, F.lit(False)) & ~F.col("_start"))
    # A chain begins at a start or at a sure report.
    seen = seen.withColumn("_chain", F.count_if(F.col("_sure")).over(part))
    # What is first after now + quiet in the chain: read backward, the last sample seen before a probe at that time.
    probe = F.struct((F.col("now") + quiet).alias("at"), F.lit(0).alias("side"))
    sample = F.struct(F.col("now").alias("at"), F.lit(1).alias("side"))
    both = seen.select("*", F.explode(F.when(F.col("_start"), F.array(probe)).otherwise(F.array(probe, sample))).alias("_row"))
    back = Window.partitionBy("session", "_part", "_chain").orderBy(F.desc("_row.at"), "_row.side", F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(F.col("_row.side") == 1, F.col("event_id")), ignorenulls=True).over(back)
    return both.withColumn("after", after).where("_row.side = 0").select("event_id", "session", "_start", "_sure", "after")


def emitted(rows: DataFrame, quiet: int) -> DataFrame:
    """event_id, session and event_type (no_face, multiple_faces) of what samples (event_id, session, ts, faces) report; event_id is a key. Rows without a session belong to no one."""
    graph = stored(successors(rows, quiet), "successors")
    kind = lambda df, name: df.select("event_id", "session", F.lit(name).alias("event_type"))
    several = kind(rows.where("faces > 1 and session is not null"), "multiple_faces")
    reached = graph.where("_sure or _start").select("event_id")
    jumps = graph.where("after is not null").select("event_id", "after")
    while jumps.limit(1).count():
        # What is 2 ** k successors after something reached, and then jumps twice as far.
        more = jumps.join(reached, "event_id").select(F.col("after").alias("event_id"))
        far = jumps.select(F.col("event_id").alias("after"), F.col("after").alias("_far"))
        reached, jumps = stored(reached.unionByName(more).distinct(), "reached"), stored(jumps.join(far, "after").select("event_id", F.col("_far").alias("after")), "jumps")
    return kind(graph.where("not _start").join(reached, "event_id"), "no_face").unionByName(several)
