"""Strike accounting over violation reports: ordered, thresholded counts with a terminating limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import THRESHOLD

ORDER = ["ts", "event_id"]
# Texts shown to the candidate.
MANAGER_WARNINGS = {
    1: "⚠️ Warning: Please keep your eyes focused on the screen during the interview.",
    2: "⚠️ FINAL WARNING: One more violation will result in interview termination.",
    3: "🚫 Interview terminated due to suspected cheating. This session has been flagged for review.",
}
TERMINATED = "Interview terminated due to suspected cheating. This session has been flagged for review."
REASON_HEAD = "Interview terminated after {0} strikes (maximum: {0}).\n\nViolations detected:\n"
REASON_FOOT = "\nThis session has been flagged for manual review. All detected violations were above the {:.0%} confidence threshold."
LAST_WARNING, ANY_WARNING, STRIKE_ISSUED, SOCKET_TERMINATED = "STRIKE {}/{}: One more violation will terminate your interview.", "STRIKE {}/{}: Suspicious activity detected.", "Strike {} issued.", "Interview terminated due to suspected cheating."
SOCKET_WARNINGS = {1: "STRIKE 1/2: Suspicious activity detected. One more violation will terminate your interview.", 2: "FINAL STRIKE: Interview will be terminated immediately on next violation."}


def accepted(reports: DataFrame) -> DataFrame:
    return reports.where(F.col("confidence") >= THRESHOLD)


def timeline(reports: DataFrame, max_strikes: int) -> DataFrame:
    """The recorded violations of each interview: the first max_strikes accepted ones, the last of which terminates."""
    w = Window.partitionBy("interview_id").orderBy(*ORDER)
    out = accepted(reports).withColumn("strike_number", F.row_number().over(w).cast("long")).where(F.col("strike_number") <= max_strikes)
    return out.withColumn("terminates", F.col("strike_number") == max_strikes)


def summary(reports: DataFrame, max_strikes: int) -> DataFrame:
    """Strikes, whether the limit was reached, and the reports of each interview; partial counts, no ordering needed."""
    n = F.count_if(F.col("confidence") >= THRESHOLD)
    return reports.groupBy("interview_id").agg(F.count(F.lit(1)).alias("reports"), F.least(n, F.lit(max_strikes)).alias("strikes"), (n >= max_strikes).alias("max_reached"))


def title(kind: Column) -> Column:
    return F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))


def percent(x: Column) -> Column:
    """Half-even, as 62% of 0.625."""
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def termination_reasons(reports: DataFrame, max_strikes: int) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("strike_number", "event_type", "confidence")))
    text = F.transform(lines, lambda e: F.concat(e["strike_number"].cast("string"), F.lit(". "), title(e["event_type"]), F.lit(" (Confidence: "), percent(e["confidence"]), F.lit(")\n")))
    head, foot = REASON_HEAD.format(max_strikes), REASON_FOOT.format(THRESHOLD)
    out = timeline(reports, max_strikes).groupBy("interview_id").agg(F.count(F.lit(1)).alias("strikes"), text.alias("lines")).where(F.col("strikes") == max_strikes)
    return out.select("interview_id", "strikes", F.concat(F.lit(head), F.array_join("lines", ""), F.lit(foot)).alias("reason"))


def manager_replay(reports: DataFrame, max_strikes: int) -> DataFrame:
    """The stricter counter that never stops: it goes on past the limit, and asks for termination only at accepted reports."""
    w = Window.partitionBy("interview_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("confidence") >= THRESHOLD
    n = F.count_if(ok).over(w)
    warning = F.when(~ok, "")
    for k, text in MANAGER_WARNINGS.items():
        warning = warning.when(n == k, text)
    warning = warning.otherwise(F.replace(F.lit(STRIKE_ISSUED), F.lit("{}"), n.cast("string")))
    return reports.select("event_id", "interview_id", ok.alias("strike_added"), n.alias("current_strikes"), (ok & (n >= max_strikes)).alias("should_terminate"), warning.alias("warning"))


def report_warning(strike: Column, max_strikes: int) -> Column:
    def numbered(text: str) -> Column:
        return F.replace(F.lit(text.format("#", max_strikes)), F.lit("#"), strike.cast("string"))

    return F.when(strike >= max_strikes, TERMINATED).when(strike == max_strikes - 1, numbered(LAST_WARNING)).otherwise(numbered(ANY_WARNING))


def socket_warning(strike: Column) -> Column:
    return F.when(strike == 1, SOCKET_WARNINGS[1]).when(strike == 2, SOCKET_WARNINGS[2]).otherwise("Interview terminated.")


def reconcile(recorded: DataFrame, pushed: DataFrame) -> DataFrame:
    """Strikes by both paths against the recorded events: the socket path counts without recording."""
    both = accepted(recorded).select("interview_id", F.lit(1).alias("r"), F.lit(0).alias("p")).unionByName(accepted(pushed).select("interview_id", F.lit(0).alias("r"), F.lit(1).alias("p")))
    return both.groupBy("interview_id").agg(F.sum("r").alias("recorded_events"), F.count(F.lit(1)).alias("strikes"), F.sum("p").alias("unrecorded"))


def stack_depth(ops: DataFrame) -> DataFrame:
    """Strikes after each of add, pop and reset: a walk reflected at zero inside the rows between resets."""
    w = Window.partitionBy("interview_id").orderBy(*ORDER)
    step = F.when(F.col("op") == "add", 1).when(F.col("op") == "pop", -1).otherwise(0)
    out = ops.withColumn("epoch", F.count_if(F.col("op") == "reset").over(w)).withColumn("step", step)
    e = Window.partitionBy("interview_id", "epoch").orderBy(*ORDER)
    out = out.withColumn("s", F.sum("step").over(e))
    return out.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(e))).drop("step", "s")
