"""Relational audits of interviews and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored


def detail(interviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """Interviews with their candidate embedded."""
    return interviews.join(candidates, "resume_id").select("interview_id", "status", "created_at", F.struct("resume_id", "candidate_name", "segment").alias("resume"))


def active_conflicts(interviews: DataFrame) -> DataFrame:
    """Candidates with more than one interview in progress."""
    return interviews.where("status = 'in_progress'").groupBy("resume_id").agg(F.count(F.lit(1)).alias("active"), F.min("interview_id").alias("first_interview")).where("active > 1")


def startable(candidates: DataFrame, interviews: DataFrame) -> DataFrame:
    """Candidates without an interview in progress: a start for the others is a conflict."""
    return candidates.join(interviews.where("status = 'in_progress'"), "resume_id", "left_anti")


def orphans(interviews: DataFrame, candidates: DataFrame) -> DataFrame:
    return interviews.join(candidates, "resume_id", "left_anti")


def latest(interviews: DataFrame) -> DataFrame:
    """Each candidate's last interview, ties to the greater id: a partial aggregate, no sort of a candidate's rows."""
    return interviews.groupBy("resume_id").agg(F.max(F.struct("created_at", "interview_id", "status")).alias("l")).select("resume_id", "l.interview_id", "l.status", "l.created_at")


def search(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows where a column contains the text, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(c), F.lit(text.lower()))
    return rows.where(hit)


def transition_error(before: Column, after: Column) -> Column:
    """Why a status change is refused, or null: pending to in_progress to completed or terminated."""
    ok = ((before == "pending") & (after == "in_progress")) | ((before == "in_progress") & after.isin("completed", "terminated"))
    return F.when(ok, None).otherwise(F.concat(F.lit("cannot go from "), before, F.lit(" to "), after))


def transitions(interviews: DataFrame) -> DataFrame:
    """Each candidate's successive statuses, and whether the state machine has that change."""
    w = Window.partitionBy("resume_id").orderBy("created_at", "interview_id")
    rows = interviews.withColumn("before", F.lag("status").over(w)).where("before is not null")
    return rows.groupBy("before", F.col("status").alias("after")).agg(F.count(F.lit(1)).alias("changes")).withColumn("refused", transition_error(F.col("before"), F.col("after")).isNotNull())


def cascade(tables: list[tuple[str, DataFrame, str, str]], root: DataFrame, key: str) -> dict[str, DataFrame]:
    """Rows that go with the root's: tables are (name, rows, foreign key, own key) from parent to child."""
    out, victims, of = {}, root, key
    for name, rows, foreign, own in tables:
        victims = rows.join(victims.select(F.col(of).alias(foreign)), foreign, "left_semi")
        out[name], of = victims, own
    return out


def cascade_counts(tables: list[tuple[str, DataFrame, str, str]], root: DataFrame, key: str) -> DataFrame:
    """child and victims: how many rows of each table go with the root's. Each table is read once; a level's keys are written for the next."""
    out, victims, of = None, root, key
    for name, rows, foreign, own in tables:
        keys = rows.select(F.col(own).alias("_own"), F.col(foreign).alias("_foreign"))
        victims = stored(keys.join(victims.select(F.col(of).alias("_foreign")), "_foreign", "left_semi").select("_own"), name)
        n = victims.agg(F.lit(name).alias("child"), F.count(F.lit(1)).alias("victims"))
        out, of = n if out is None else out.unionByName(n), "_own"
    return out


def error_code(name: Column) -> Column:
    """A class name in lower case without error and exception; unknown_error if nothing is left."""
    code = F.replace(F.replace(F.lower(name), F.lit("error"), F.lit("")), F.lit("exception"), F.lit(""))
    return F.when(code == "", "unknown_error").otherwise(code)


def duration_seconds(start: Column, end: Column) -> Column:
    """Null unless both are set."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def open_duration_seconds(start: Column, end: Column, as_of: Column) -> Column:
    """An open end counts as as_of; 0 without a start."""
    return F.when(start.isNull(), 0.0).otherwise(duration_seconds(start, F.coalesce(end.cast("timestamp"), as_of.cast("timestamp"))))


def shown_minutes(seconds: Column) -> Column:
    """Whole minutes, halves up."""
    return F.floor(seconds / 60 + 0.5)


# Kind of an error, status and code; all others are internal.
ERROR_CLASSES = {"DatabaseError": (503, "database_error"), "OperationalError": (503, "database_error"), "ValidationError": (400, "validation_error")}


def error_class(name: Column) -> Column:
    """(status, code) of an unhandled error's class name."""
    out = None
    for kind, (status, code) in ERROR_CLASSES.items():
        value = F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"))
        out = F.when(name == kind, value) if out is None else out.when(name == kind, value)
    return out.otherwise(F.struct(F.lit(500).alias("status"), F.lit("internal_error").alias("code")))


# The text of a refused command.
REFUSED = "Cannot {} interview with status: "


def commands(log: DataFrame) -> DataFrame:
    """status and refused of each command (interview_id, ts, event_id, command: start, end, terminate), all interviews pending at first.

    The first start is taken, and then the first end or terminate; every other command is refused and says which status stood.
    """
    w = Window.partitionBy("interview_id").orderBy("ts", "event_id")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("command") == "start"
    out = log.withColumn("_started", F.count_if(starts).over(before) > 0)
    out = out.withColumn("_finish", F.when(~starts & F.col("_started"), F.when(F.col("command") == "terminate", "terminated").otherwise("completed")))
    out = out.withColumn("_was", F.coalesce(F.first("_finish", ignorenulls=True).over(before), F.when(F.col("_started"), "in_progress").otherwise("pending")))
    out = out.withColumn("status", F.coalesce(F.first("_finish", ignorenulls=True).over(upto), F.when(F.col("_started") | starts, "in_progress").otherwise("pending")))
    taken = F.when(starts, F.col("_was") == "pending").otherwise(F.col("_was") == "in_progress")
    refusal = F.when(starts, REFUSED.format("start")).otherwise(REFUSED.format("end"))
    return out.withColumn("refused", F.when(~taken, F.concat(refusal, F.col("_was")))).drop("_started", "_finish", "_was")


def children(parents: DataFrame, rows: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """parents with an ordered array of their rows, empty for those without any."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias(name))
    joined = parents.join(listed, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with changed rows replaced by those of changes and new ones added; each key is in changes once, and columns agree."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes.select(*table.columns))


def get(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none; the filter reaches the scan."""
    return rows.where(F.col(key) == value)


def listing(rows: DataFrame, *, filters: dict | None = None, columns: list[str] = (), text: str = "", order: list[Column] = (), page: int | None = None) -> DataFrame:
    """A list view: equality filters, a search text in any of the columns, an order, and the first page of it."""
    out = rows
    for column, value in (filters or {}).items():
        out = out.where(F.col(column) == value)
    if text:
        out = search(out, list(columns), text)
    if order:
        out = out.orderBy(*order)
    return out if page is None else out.limit(page)


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with new rows; columns that they lack are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def update_fields(table: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """table with the named fields of the changed rows replaced, by nulls too; all other columns stay, unknown keys add nothing. A key that is in changes twice raises an error."""
    repeated = F.raise_error(F.concat(F.lit("a key is in changes more than once: "), F.col(key).cast("string")))
    new = changes.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*fields)).alias("_new"))
    new = new.select(F.col(key).alias("_key"), F.when(F.col("_n") > 1, repeated.cast(new.schema["_new"].dataType)).otherwise(F.col("_new")).alias("_new"))
    out = table.join(new, F.col(key) == F.col("_key"), "left")
    return out.select(*(F.when(F.col("_key").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns))


def iso(ts: Column) -> Column:
    """A time as ISO text: fractions of six digits where there are any."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(ts, "SSSSSS") == "000000", "").otherwise(F.date_format(ts, ".SSSSSS")))
