"""Behaviour patterns over gaze samples, in windows of a count of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaze_patterns(samples: DataFrame) -> DataFrame:
    """frequency, interval mean and deviation, half rates and pattern_type after each sample (session, ts, event_id, away).

    All windows are of one partitioning. The last 19 look-aways are a range of their running count, so no join brings them to
    the samples between; the halves of the last 100 samples are differences of it, and only a session's first 99 samples need a
    list of those before them. A null away counts as none.
    """
    samples = samples.withColumn("away", F.coalesce("away", F.lit(0)))
    base = Window.partitionBy("session").orderBy("ts", "event_id")
    upto = base.rowsBetween(Window.unboundedPreceding, 0)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = samples.withColumn("_at", at).withColumn("_n", F.sum("away").over(upto))
    gap = F.col("_at") - F.last(F.when(F.col("away") == 1, F.col("_at")), ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_gap", F.when((F.col("away") == 1) & (gap > 0), gap))
    rows = rows.withColumn("_k", F.row_number().over(base)).withColumn("held", F.collect_list(F.when(F.col("_k") < 100, F.col("away"))).over(base.rowsBetween(-99, 0))).withColumn("frequency", F.avg("away").over(base.rowsBetween(-29, 0)))
    last = Window.partitionBy("session").orderBy("_n").rangeBetween(-18, 0)
    seen = F.col("_n") > 0
    rows = rows.withColumn("n_away", F.when(seen, F.col("_n"))).withColumn("n_gaps", F.when(seen, F.count("_gap").over(last))).withColumn("gap_mean", F.avg("_gap").over(last)).withColumn("gap_dev", F.stddev_pop("_gap").over(last))
    n = F.least("_k", F.lit(100))
    half = F.floor(n / 2).cast("int")

    def rate(total, part, size):
        few = F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)
        return F.try_divide(F.when(F.col("_k") < 100, few).otherwise(total), size)

    middle = F.lag("_n", 50).over(base)
    before = F.coalesce(F.lag("_n", 100).over(base), F.lit(0))
    rows = rows.withColumn("n", n).withColumn("_middle", middle).withColumn("_before", before)
    rows = rows.withColumn("early", rate(F.col("_middle") - F.col("_before"), F.slice("held", F.lit(1), half), half)).withColumn("late", rate(F.col("_n") - F.col("_middle"), F.slice("held", half + 1, n - half), n - half))
    change = F.col("late") - F.col("early")
    regular = (F.col("n_away") >= 5) & (F.col("n_gaps") >= 3) & (F.col("gap_mean") > 0) & (F.try_divide("gap_dev", "gap_mean") < 0.15)
    kind = F.when(F.col("n") < 10, "insufficient_data").when(F.col("frequency") > 0.4, "frequent_lookaway").when(regular, "regular_pattern").when((F.col("n") >= 20) & (change > 0) & (F.abs(change) > 0.3), "behavior_change").otherwise("normal")
    sure = F.when(F.col("n") < 10, 0.0).when(F.col("frequency") > 0.4, F.least(0.5 + F.col("frequency"), F.lit(0.95))).when(regular, 0.85).when((F.col("n") >= 20) & (change > 0) & (F.abs(change) > 0.3), 0.7 + 0.3 * F.abs(change)).otherwise(0.0)
    return rows.select("event_id", "session", "frequency", "n_away", "n_gaps", "gap_mean", "gap_dev", "early", "late", kind.alias("pattern_type"), sure.alias("confidence"))


def session_summary(samples: DataFrame, last: int = 100) -> DataFrame:
    """Counts, rate and span in seconds of each session's last samples."""
    w = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("event_id"))
    kept = samples.withColumn("k", F.row_number().over(w)).where(F.col("k") <= last)
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return kept.groupBy("session").agg(F.count(F.lit(1)).alias("samples"), F.sum("away").alias("away"), F.avg("away").alias("rate"), span.alias("seconds"))
