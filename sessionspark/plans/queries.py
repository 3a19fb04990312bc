"""Every query of the session engine, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import audio, extraction, geometry, keywords
from ..operators import asof, debounce, lifecycle, messages, patterns, quality, questions, scan, strikes, turns
from ..sources import documents, tables
from ..streaming import processors, state

AS_OF_YEAR = 2024
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_V = """v as (select event_id, user_id as interview_id, ts, case event_type when 'view' then 'looking_away' when 'signup' then 'tab_switch' when 'error' then 'no_face' when 'click' then 'window_blur' else 'copy_attempt' end as event_type,
 least(value / 100.0, 1.0) as confidence from events)"""
_A = f"{_V}, a as (select *, row_number() over (partition by interview_id order by ts, event_id) as strike_number from v where confidence >= 0.6)"
_TITLE = "case event_type when 'looking_away' then 'Looking Away' when 'tab_switch' then 'Tab Switch' when 'no_face' then 'No Face' when 'window_blur' then 'Window Blur' else 'Copy Attempt' end"


@query(f"with {_A} select interview_id, event_id, ts, event_type, round(confidence, 6) as confidence, strike_number, strike_number = 2 as terminates from a where strike_number <= 2")
def strike_timeline(spark: SparkSession, d: str) -> DataFrame:
    return strikes.timeline(tables.violations(spark, d), 2).withColumn("confidence", F.round("confidence", 6))


@query(f"with {_V} select interview_id, count(*) as reports, least(count(*) filter (confidence >= 0.6), 20) as strikes, count(*) filter (confidence >= 0.6) >= 20 as max_reached from v group by 1")
def strike_summary(spark, d):
    return strikes.summary(tables.violations(spark, d), 20)


@query(f"""with {_A} select interview_id, count(*) as strikes, 'Interview terminated after 2 strikes (maximum: 2).' || chr(10) || chr(10) || 'Violations detected:' || chr(10)
 || string_agg(strike_number || '. ' || {_TITLE} || ' (Confidence: ' || round_even(confidence * 100, 0)::int || '%)' || chr(10), '' order by strike_number)
 || chr(10) || 'This session has been flagged for manual review. All detected violations were above the 60% confidence threshold.' as reason from a where strike_number <= 2 group by 1 having count(*) = 2""")
def termination_report(spark, d):
    return strikes.termination_reasons(tables.violations(spark, d), 2)


@query(f"""with {_V}, n as (select *, confidence >= 0.6 as ok, count(*) filter (confidence >= 0.6) over (partition by interview_id order by ts, event_id rows unbounded preceding) as n from v)
 select event_id, interview_id, ok as strike_added, n as current_strikes, ok and n >= 2 as should_terminate, case when not ok then '' {' '.join(f"when n = {k} then {_q(t)}" for k, t in strikes.MANAGER_WARNINGS.items())} else 'Strike ' || n || ' issued.' end as warning from n""")
def strike_manager_replay(spark, d):
    return strikes.manager_replay(tables.violations(spark, d), 2)


@query(f"""with {_A} select interview_id, strike_number, case when strike_number >= 4 then {_q(strikes.TERMINATED)} when strike_number = 3 then 'STRIKE 3/4: One more violation will terminate your interview.' else 'STRIKE ' || strike_number || '/4: Suspicious activity detected.' end as report_text,
 case strike_number when 1 then {_q(strikes.SOCKET_WARNINGS[1])} when 2 then {_q(strikes.SOCKET_WARNINGS[2])} else 'Interview terminated.' end as socket_text from a where strike_number <= 4""")
def warning_messages(spark, d):
    n = F.col("strike_number")
    return strikes.timeline(tables.violations(spark, d), 4).select("interview_id", "strike_number", strikes.report_warning(n, 4).alias("report_text"), strikes.socket_warning(n).alias("socket_text"))


@query(f"with {_V} select interview_id, count(*) filter (event_id % 2 = 0) as recorded_events, count(*) as strikes, count(*) filter (event_id % 2 = 1) as unrecorded from v where confidence >= 0.6 group by 1")
def strike_reconcile(spark, d):
    v = tables.violations(spark, d)
    return strikes.reconcile(v.where("event_id % 2 = 0"), v.where("event_id % 2 = 1"))


# The confidence that the client sends with each type.
CLIENT_CONFIDENCE = {"tab_switch": 1.0, "window_blur": 0.85, "no_face": 0.8, "multiple_faces": 0.9, "right_click": 0.65, "copy_attempt": 0.7, "looking_away": 0.85}


@query(f"with {_V}, c(event_type, client_confidence) as (values {', '.join(f'({_q(k)}, {v}::double)' for k, v in CLIENT_CONFIDENCE.items())}) select event_type, count(*) as reports, round(avg(confidence), 6) as mean_confidence, client_confidence, client_confidence >= 0.6 as always_counts from v join c using (event_type) group by event_type, client_confidence")
def violation_type_counts(spark, d):
    known = spark.createDataFrame(list(CLIENT_CONFIDENCE.items()), "event_type string, client_confidence double")
    grouped = tables.violations(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("reports"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return grouped.join(known, "event_type").withColumn("always_counts", F.col("client_confidence") >= 0.6)


@query(f"with {_A} select interview_id, string_agg(strike_number || ':' || event_type, ',' order by strike_number) as events from a where strike_number <= 20 group by 1")
def strike_audit(spark, d):
    t = strikes.timeline(tables.violations(spark, d), 20)
    listed = F.array_sort(F.collect_list(F.struct("strike_number", "event_type")))
    return t.groupBy("interview_id").agg(F.array_join(F.transform(listed, lambda e: F.concat_ws(":", e["strike_number"].cast("string"), e["event_type"])), ",").alias("events"))


_G = """s as (select event_id, user_id, ts, (event_type in ('error','click'))::int la from events),
g as (select *, lag(ts) over (partition by user_id order by ts, event_id) pts from s where la = 1),
gi as (select *, case when ts > pts then epoch_us(ts)/1e6 - epoch_us(pts)/1e6 end d from g),
gl as (select event_id, count(*) over w0 ne, count(d) over w ni, avg(d) over w m, stddev_pop(d) over w sd from gi
 window w as (partition by user_id order by ts, event_id rows between 18 preceding and current row), w0 as (partition by user_id order by ts, event_id rows unbounded preceding)),
j as (select s.*, list(la) over (partition by user_id order by ts, s.event_id rows between 99 preceding and current row) h, avg(la) over (partition by user_id order by ts, s.event_id rows between 29 preceding and current row) f,
 last_value(ne ignore nulls) over p ne, last_value(ni ignore nulls) over p ni, last_value(m ignore nulls) over p m, last_value(sd ignore nulls) over p sd from s left join gl using (event_id)
 window p as (partition by user_id order by ts, s.event_id rows unbounded preceding)),
k as (select *, len(h) n, case when len(h) > 1 then list_sum(h[1:len(h)//2]) / (len(h)//2)::double end a, list_sum(h[len(h)//2+1:]) / (len(h)-len(h)//2)::double b from j)"""


@query(f"""with {_G} select event_id, case when n < 10 then 'insufficient_data' when f > 0.4 then 'frequent_lookaway' when ne >= 5 and ni >= 3 and m > 0 and sd/m < 0.15 then 'regular_pattern' when n >= 20 and b > a and abs(b-a) > 0.3 then 'behavior_change' else 'normal' end as pattern_type,
 round(case when n < 10 then 0.0 when f > 0.4 then least(0.5 + f, 0.95) when ne >= 5 and ni >= 3 and m > 0 and sd/m < 0.15 then 0.85 when n >= 20 and b > a and abs(b-a) > 0.3 then 0.7 + 0.3 * abs(b-a) else 0.0 end, 6) as confidence from k""")
def gaze_pattern(spark, d):
    return patterns.gaze_patterns(tables.gaze_samples(spark, d)).select("event_id", "pattern_type", F.round("confidence", 6).alias("confidence"))


@query(f"with {_G} select event_id, round(f, 6) as frequency, f > 0.4 as frequent from k")
def gaze_frequency(spark, d):
    return patterns.gaze_patterns(tables.gaze_samples(spark, d)).select("event_id", F.round("frequency", 6).alias("frequency"), (F.col("frequency") > 0.4).alias("frequent"))


@query(f"with {_G} select event_id, ne as n_away, ni as n_gaps, round(m, 4) as gap_mean, round(sd, 3) as gap_dev from k")
def gaze_intervals(spark, d):
    return patterns.gaze_patterns(tables.gaze_samples(spark, d)).select("event_id", "n_away", "n_gaps", F.round("gap_mean", 4).alias("gap_mean"), F.round("gap_dev", 3).alias("gap_dev"))


@query(f"with {_G} select event_id, round(a, 6) as early, round(b, 6) as late from k")
def gaze_behavior_change(spark, d):
    return patterns.gaze_patterns(tables.gaze_samples(spark, d)).select("event_id", F.round("early", 6).alias("early"), F.round("late", 6).alias("late"))


@query("""with s as (select user_id as session, ts, (event_type in ('error','click'))::int as away, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
 select session, count(*) as samples, sum(away)::bigint as away, round(avg(away), 6) as rate, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) as seconds from s where k <= 100 group by 1""")
def gaze_session_summary(spark, d):
    return patterns.session_summary(tables.gaze_samples(spark, d)).withColumn("rate", F.round("rate", 6)).withColumn("seconds", F.round("seconds", 3))


_LINES = r"list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1:5], lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g'))"


@query(rf"""select doc_id, left(regexp_extract(text, '{extraction.EMAIL}', 0), 254) as email, left(regexp_extract(text, '{extraction.PHONE}', 0), 50) as phone,
 left(coalesce(list_filter({_LINES}, lambda l: l <> '' and len(string_split_regex(l, '\s+')) <= 4 and not regexp_matches(l, '\d') and not contains(lower(l), 'resume') and not contains(lower(l), 'cv') and not contains(lower(l), 'curriculum'))[1], ''), 255) as name from documents""")
def resume_contacts(spark, d):
    t = F.col("text")
    return tables.table(spark, d, "documents").select("doc_id", extraction.email(t).alias("email"), extraction.phone(t).alias("phone"), extraction.name(t).alias("name"))


_SKILLS = "list_sort(list_distinct(list_transform(list_filter([" + ", ".join(f"{{'k': {_q(s)}, 'n': {_q(extraction.display(s))}}}" for s in [*extraction.TECH_SKILLS, *extraction.SOFT_SKILLS]) + "], lambda s: contains(lower(text), s.k)), lambda s: s.n)))"


def _skilled(spark, d):
    return extraction.with_skills(tables.table(spark, d, "documents").select("doc_id", "text"), name="s").drop("text")


@query(f"select doc_id, array_to_string({_SKILLS}, ',') as skills, len({_SKILLS})::int as n_skills from documents")
def resume_skills(spark, d):
    return _skilled(spark, d).select("doc_id", F.array_join("s", ",").alias("skills"), F.size("s").alias("n_skills"))


@query(f"select skill, count(*) as resumes from (select unnest({_SKILLS}) as skill from documents) group by 1")
def skill_counts(spark, d):
    # explode_outer: explode would add a filter on the match, which is then made twice
    counts = _skilled(spark, d).select(F.explode_outer("s").alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("resumes"))
    return counts.where("skill is not null")


_DICT = "k as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as keyword from benchmark)"


@query(f"with {_DICT} select doc_id, count(keyword)::int as n_keywords, sha256(coalesce(string_agg(keyword, ',' order by keyword), '')) as listed from documents left join k on contains(lower(text), keyword) group by doc_id")
def dictionary_matches(spark, d):
    """Keywords from a table: the words of all benchmark items, anywhere in the resumes."""
    words = tables.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("keyword")).withColumn("name", F.col("keyword"))
    found = keywords.with_matches(tables.table(spark, d, "documents").select("doc_id", "text"), F.lower("text"), words, "found")
    return found.select("doc_id", F.coalesce(F.size("found"), F.lit(0)).alias("n_keywords"), F.sha2(F.coalesce(F.array_join("found", ","), F.lit("")).cast("binary"), 256).alias("listed"))


@query(f"select doc_id, array_to_string(regexp_extract_all(text, {_q(extraction.DEGREE)}, 1)[1:3], '|') as degrees from documents")
def resume_education(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.array_join(extraction.education(F.col("text")), "|").alias("degrees"))


_YEARED = "(text || ' ' || (1990 + doc_id % 30) || ' - ' || (1995 + doc_id % 35) || ', 2018 – Present')"


@query(f"""with t as (select doc_id, {_YEARED} as text from documents), s as (select doc_id, regexp_extract_all(text, {_q(extraction.SPAN)}, 1)[1:5] as a, regexp_extract_all(text, {_q(extraction.SPAN)}, 2)[1:5] as b from t)
 select doc_id, array_to_string(list_transform(list_zip(a, b), lambda z: z[1] || ' - ' || z[2]), '|') as spans, least(list_sum(list_transform(list_zip(a, b), lambda z: greatest(0, coalesce(try_cast(z[2] as int), 2024) - z[1]::int)))::double, 50.0) as years from s""")
def resume_experience(spark, d):
    """Job spans; the documents have none, so two are written after each text."""
    docs = tables.table(spark, d, "documents")
    t = F.concat("text", F.lit(" "), (1990 + F.col("doc_id") % 30).cast("string"), F.lit(" - "), (1995 + F.col("doc_id") % 35).cast("string"), F.lit(", 2018 – Present"))
    return docs.select("doc_id", F.array_join(extraction.job_spans(t), "|").alias("spans"), extraction.experience_years(t, AS_OF_YEAR).alias("years"))


_LINK = "case " + " ".join(f"when {' or '.join(f'contains(lower(u), {_q(p)})' for p in parts)} then {_q(kind)}" for kind, parts in extraction.LINK_RULES) + " else 'other' end"


@query(f"select page_id, {_LINK.replace('(u)', '(url)')} as kind from pages")
def link_classify(spark, d):
    return tables.table(spark, d, "pages").select("page_id", extraction.link_class(F.col("url")).alias("kind"))


@query(f"""select page_id, {_LINK} as kind, count(*) as links from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as u from pages) group by 1, 2""")
def page_links(spark, d):
    return documents.hrefs(tables.table(spark, d, "pages")).groupBy("page_id", extraction.link_class(F.col("href")).alias("kind")).agg(F.count(F.lit(1)).alias("links"))


_I = "i as (select o_orderkey as interview_id, o_custkey as resume_id, case o_orderstatus when 'P' then 'pending' when 'O' then 'in_progress' else 'completed' end as status, o_orderdate as created_at from orders)"


@query(f"with {_I} select interview_id, status, created_at, c_custkey as resume_id, c_name as candidate_name, c_mktsegment as segment from i join customer on resume_id = c_custkey")
def interview_detail(spark, d):
    return lifecycle.detail(tables.interviews(spark, d), tables.candidates(spark, d)).select("interview_id", "status", "created_at", "resume.*")


@query(f"with {_I} select resume_id, count(*) as active, min(interview_id) as first_interview from i where status = 'in_progress' group by 1 having count(*) > 1")
def active_conflicts(spark, d):
    return lifecycle.active_conflicts(tables.interviews(spark, d))


@query(f"with {_I} select c_custkey as resume_id, c_name as candidate_name, c_mktsegment as segment from customer where c_custkey not in (select resume_id from i where status = 'in_progress')")
def startable_candidates(spark, d):
    return lifecycle.startable(tables.candidates(spark, d), tables.interviews(spark, d))


@query(f"with {_I} select interview_id, resume_id, status from i where resume_id not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')")
def orphan_interviews(spark, d):
    return lifecycle.orphans(tables.interviews(spark, d), tables.candidates(spark, d).where("segment <> 'BUILDING'")).select("interview_id", "resume_id", "status")


@query("""with n as (select * from nation where n_regionkey = 1), c as (select * from customer where c_nationkey in (select n_nationkey from n)), o as (select * from orders where o_custkey in (select c_custkey from c)), l as (select * from lineitem where l_orderkey in (select o_orderkey from o))
 select 'nation' as child, count(*) as victims from n union all select 'customer', count(*) from c union all select 'orders', count(*) from o union all select 'lineitem', count(*) from l""")
def cascade_delete_counts(spark, d):
    def t(n):
        return tables.table(spark, d, n)

    return lifecycle.cascade_counts([("nation", t("nation"), "n_regionkey", "n_nationkey"), ("customer", t("customer"), "c_nationkey", "c_custkey"), ("orders", t("orders"), "o_custkey", "o_orderkey"), ("lineitem", t("lineitem"), "l_orderkey", "l_orderkey")], t("region").where("r_regionkey = 1"), "r_regionkey")


@query(f"with {_I} select resume_id, interview_id, status, created_at from (select *, row_number() over (partition by resume_id order by created_at desc, interview_id desc) as k from i) where k = 1")
def latest_interview_per_candidate(spark, d):
    return lifecycle.latest(tables.interviews(spark, d))


@query("select l_orderkey as interview_id, count(*) as questions, string_agg(l_linenumber::varchar, ',' order by l_linenumber) as numbers from lineitem group by 1")
def questions_per_interview(spark, d):
    q = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("interview_id"))
    return q.agg(F.count(F.lit(1)).alias("questions"), F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("numbers"))


@query(f"with {_I} select interview_id, c_name as candidate_name, status from i join customer on resume_id = c_custkey where contains(lower(c_name), '00077') or contains(lower(status), 'pend')")
def admin_search(spark, d):
    rows = tables.interviews(spark, d).join(tables.candidates(spark, d), "resume_id")
    hit = F.contains(F.lower("candidate_name"), F.lit("00077")) | F.contains(F.lower("status"), F.lit("pend"))
    return rows.where(hit).select("interview_id", "candidate_name", "status")


@query("select event_id, (props->>'$.k')::bigint as k, coalesce(props->>'$.message', '') as message from events")
def details_json(spark, d):
    p = F.from_json("props", "k bigint, message string")
    return tables.table(spark, d, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["message"], F.lit("")).alias("message"))


@query(f"""with {_I}, w as (select status as after, lag(status) over (partition by resume_id order by created_at, interview_id) as before from i)
 select before, after, count(*) as changes, not ((before = 'pending' and after = 'in_progress') or (before = 'in_progress' and after in ('completed', 'terminated'))) as refused from w where before is not null group by 1, 2""")
def status_transitions(spark, d):
    return lifecycle.transitions(tables.interviews(spark, d))


@query("select conv_id, count(*) as turns, sum(length(text))::bigint as chars, string_agg(role, '>' order by turn) as roles from conversations group by 1")
def transcript_turns(spark, d):
    listed = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return tables.table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"), F.array_join(F.transform(listed, lambda x: x["role"]), ">").alias("roles"))


_F = """f as (select label as session, vec_id as frame_no, list_transform(embedding, lambda x: x::double) as x0 from embeddings)"""
_FG = f"""{_F}, p as (select *, list_max(list_transform(x0, lambda v: abs(v))) as peak from f), fg as (select *, case when peak > 0.001 then greatest(0.5, least(3.0, 0.7 / peak)) else 1.0 end as g from p),
 gx as (select session, frame_no, list_transform(x0, lambda v: greatest(-1.0, least(1.0, v * g))) as x, g from fg)"""
_ZCR = "list_sum(list_transform(list_zip(x[1:-2], x[2:]), lambda z: abs(sign(z[2]) - sign(z[1]))))::double / (2.0 * len(x))"
_RMS = "sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x))"
_DFT = """ft as (select session, frame_no, k, sqrt(power(sum(v * cos(2 * pi() * k * i / n)), 2) + power(sum(v * sin(2 * pi() * k * i / n)), 2)) as m, any_value(n) as n from (select session, frame_no, unnest(x) as v, generate_subscripts(x, 1) - 1 as i, len(x) as n from src), range(0, 33) t(k) group by 1, 2, 3),
 ce as (select session, frame_no, sum(k * m) / (sum(m) + 1e-8) / count(*) as centroid from ft group by 1, 2)"""


@query(f"with {_F}, src as (select session, frame_no, x0 as x from f) select session, frame_no, round({_RMS}, 6) as energy, round(list_max(list_transform(x, lambda v: abs(v))), 6) as peak, round({_ZCR}, 6) as zcr from src")
def frame_features(spark, d):
    f = turns.features(tables.frames(spark, d))
    return f.select("session", "frame_no", *(F.round(c, 6).alias(c) for c in ("energy", "peak", "zcr")))


@query(f"with {_F}, src as (select session, frame_no, x0 as x from f), {_DFT} select session, frame_no, round(centroid, 6) as centroid from ce")
def spectral_centroid(spark, d):
    return tables.frames(spark, d).select("session", "frame_no", F.round(audio.spectral_centroid("x"), 6).alias("centroid"))


@query(f"with {_FG} select session, frame_no, round(g, 6) as gain, list_sum(list_transform(x, lambda v: trunc(v * 32767)))::bigint as pcm_sum, list_max(list_transform(x, lambda v: trunc(v * 32767)))::bigint as pcm_max from gx")
def frame_gain_pcm(spark, d):
    f = tables.frames(spark, d).select("session", "frame_no", audio.gain(F.col("x")).alias("g"), audio.pcm16(audio.gained(F.col("x"))).alias("p"))
    return f.select("session", "frame_no", F.round("g", 6).alias("gain"), F.aggregate("p", F.lit(0).cast("long"), lambda s, v: s + v).alias("pcm_sum"), F.array_max("p").cast("long").alias("pcm_max"))


_W150 = "over (partition by session order by frame_no rows between 149 preceding and current row)"
_VAD = f"""{_FG}, src as (select session, frame_no, x from gx), {_DFT}, fe as (select session, frame_no, {_RMS} as energy, {_ZCR} as zcr, centroid from src join ce using (session, frame_no)),
 fl as (select *, case when count(*) {_W150} >= 30 then list_sort(list(energy) {_W150})[(count(*) {_W150} * 30) // 100 + 1] else 0.01 end as floor from fe),
 sp as (select *, ((energy > greatest(0.025, 3 * floor))::int + (zcr > 0.15 and zcr < 0.5)::int + (centroid > 0.15 and centroid < 0.7)::int >= 2)::int as speech from fl),
 ch as (select *, case when sum(speech) over (partition by session order by frame_no rows between 4 preceding and current row) = 5 then true when count(*) over w12 = 12 and sum(speech) over w12 = 0 then false end as c from sp window w12 as (partition by session order by frame_no rows between 11 preceding and current row)),
 la as (select *, coalesce(last_value(c ignore nulls) over (partition by session order by frame_no rows unbounded preceding), false) as speaking from ch)"""


@query(f"with {_VAD} select session, frame_no, round(floor, 6) as floor from fl")
def noise_floor(spark, d):
    return turns.voice_activity(tables.frames(spark, d)).select("session", "frame_no", F.round("floor", 6).alias("floor"))


@query(f"with {_VAD} select session, frame_no, speech, speaking from la")
def vad_latch(spark, d):
    return turns.voice_activity(tables.frames(spark, d)).select("session", "frame_no", "speech", "speaking")


@query(f"with {_VAD} select session, count(*) as frames, count(*) filter (speaking) as speech_frames, round((count(*) - count(*) filter (speaking)) * 100.0 / greatest(count(*), 1), 6)::double as filter_rate from la group by 1")
def audio_stats(spark, d):
    n, s = F.count(F.lit(1)), F.count_if("speaking")
    return turns.voice_activity(tables.frames(spark, d)).groupBy("session").agg(n.alias("frames"), s.alias("speech_frames"), F.round((n - s) * 100.0 / F.greatest(n, F.lit(1)), 6).alias("filter_rate"))


_COS = "cos(2 * pi() * k * i / n)"
_SIN = "sin(2 * pi() * k * i / n)"
_DENOISED = f"""{_F}, nu as (select session, frame_no, row_number() over (partition by session order by frame_no) - 1 as j, len(x0) as n, x0 from f),
 sm as (select session, frame_no, j, n, unnest(x0) as v, generate_subscripts(x0, 1) - 1 as i from nu),
 sx as (select session, frame_no, j, n, k, sum(v * {_COS}) as re, -sum(v * {_SIN}) as im from sm, range(0, 33) t(k) group by all),
 mg as (select *, sqrt(re * re + im * im) as m from sx),
 no as (select session, k, j, power(0.95, j) * (first_value(m) over w + 0.05 * (sum(m / power(0.95, j)) over w - first_value(m) over w)) as noise from mg where j < 50 window w as (partition by session, k order by j rows unbounded preceding)),
 de as (select mg.session, mg.frame_no, n, mg.k, greatest(m - 1.5 * noise, 0.1 * m) * (case when m > 0 then re / m else 1.0 end) as re, greatest(m - 1.5 * noise, 0.1 * m) * (case when m > 0 then im / m else 0.0 end) as im from mg join no on no.session = mg.session and no.k = mg.k and no.j = least(mg.j, 49)),
 ba as (select session, frame_no, i, sum((case when k = 0 or 2 * k = n then 1 else 2 end) * (re * {_COS} - im * {_SIN})) / any_value(n) as v from de, range(0, 64) t(i) group by session, frame_no, i),
 f1 as (select session, frame_no, list(v order by i) as x0 from ba group by 1, 2)"""
_AFTER = _VAD[_VAD.index(", p as") :].replace("from f)", "from f1)", 1)


@query(f"with {_DENOISED}{_AFTER} select session, frame_no, round(energy, 6) as energy, round(zcr, 6) as zcr, round(centroid, 6) as centroid, round(floor, 6) as floor, speech, speaking from la")
def audio_pipeline(spark, d):
    """Denoise, gain, vote and latch; the noise estimate is a recurrence over a session's first frames."""
    found = turns.voice_pipeline(tables.frames(spark, d))
    return found.select("session", "frame_no", *(F.round(c, 6).alias(c) for c in ("energy", "zcr", "centroid", "floor")), "speech", "speaking")


@query(f"with {_DENOISED}{_AFTER} select session, frame_no, round(energy, 6) as energy, round(zcr, 6) as zcr, round(centroid, 6) as centroid, round(floor, 6) as floor, speech, speaking from la")
def audio_stateful(spark, d):
    """audio_pipeline as a keyed rule that a stream runs frame by frame."""
    found = state.run_batch(tables.frames(spark, d), "session", state.voice_step(), state.VOICE, ("frame_no",))
    return found.select("session", "frame_no", *(F.round(c, 6).alias(c) for c in ("energy", "zcr", "centroid", "floor")), "speech", "speaking")


_E = "e as (select user_id as session, event_id, event_type, value >= 150 as speech, row_number() over (partition by user_id order by ts, event_id) as frame_no from events)"
_T = f"{_E}, sp as (select *, frame_no - lag(frame_no) over (partition by session order by frame_no) as gap from e where speech), tu as (select *, sum((gap is null or gap > 30)::int) over (partition by session order by frame_no) as turn from sp)"


def _event_frames(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    said = F.when(F.col("event_type") == "view", True).when(F.col("event_type") == "purchase", False)
    return tables.table(spark, d, "events").select(F.col("user_id").alias("session"), n.alias("frame_no"), (F.col("value") >= 150).alias("speech"), said.alias("said"))


@query(f"with {_T} select session, turn::bigint as turn, min(frame_no) as first_frame, max(frame_no) as last_frame, count(*) as n_frames, case when max(frame_no) + 30 <= any_value(ends) then max(frame_no) + 30 end as complete_frame from tu join (select session, max(frame_no) as ends from e group by 1) using (session) group by 1, 2")
def speech_turns(spark, d):
    return turns.turn_spans(_event_frames(spark, d))


@query(f"""with {_T} select session, frame_no, turn::bigint as turn, case when gap is null or gap > 30 then 'start' else 'speech' end as event from tu
 union all select session, max(frame_no) + 30, turn::bigint, 'complete' from tu join (select session, max(frame_no) as ends from e group by 1) using (session) group by session, turn having max(frame_no) + 30 <= any_value(ends)""")
def turns_stream(spark, d):
    """Turns as a keyed rule that a stream runs frame by frame."""
    return state.run_batch(_event_frames(spark, d), "session", state.turn_step(), state.TURNS, ("frame_no",))


@query(f"""with {_E}, st as (select *, coalesce(last_value(case event_type when 'view' then true when 'purchase' then false end ignore nulls) over (partition by session order by frame_no rows between unbounded preceding and 1 preceding), false) as speaking from e),
 sp as (select *, frame_no - lag(frame_no) over (partition by session order by frame_no) as gap from st where speech) select session, frame_no, speaking as barge_in from sp where gap is null or gap > 30""")
def barge_in(spark, d):
    return turns.barge_ins(_event_frames(spark, d))


@query("""with c as (select event_id, user_id as session, epoch_us(ts) / 1e6 as arrival, value * 60 as duration, sum(value * 60) over (partition by user_id order by event_id) - value * 60 as before from events)
 select event_id, session, round(before + max(arrival - before) over (partition by session order by event_id), 2) as start from c""")
def playback_schedule(spark, d):
    e = tables.table(spark, d, "events").select("event_id", F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrival"), (F.col("value") * 60).alias("duration"))
    return turns.playback(e).select("event_id", "session", F.round("start", 2).alias("start"))


@query("""with o as (select event_id, user_id as interview_id, ts, case when event_type = 'signup' and event_id % 7 = 0 then 'reset' when event_type = 'error' then 'pop' else 'add' end as op from events),
 e as (select *, count(*) filter (op = 'reset') over (partition by interview_id order by ts, event_id) as epoch, case op when 'add' then 1 when 'pop' then -1 else 0 end as step from o),
 s as (select *, sum(step) over (partition by interview_id, epoch order by ts, event_id) as s from e) select event_id, interview_id, op, (s - least(0, min(s) over (partition by interview_id, epoch order by ts, event_id)))::bigint as depth from s""")
def strike_stack(spark, d):
    op = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 7 == 0), "reset").when(F.col("event_type") == "error", "pop").otherwise("add")
    return strikes.stack_depth(tables.table(spark, d, "events").select("event_id", F.col("user_id").alias("interview_id"), "ts", op.alias("op"))).select("event_id", "interview_id", "op", "depth")


# Two tables in event time, in ms: user frames and model events.
_TWO = """r as (select user_id as session, epoch_us(ts) // 1000 as ms, 0 as source, event_id as id, value >= 150 as speech, value as energy, null::boolean as said from events
 union all select conv_id, 1704067200000 + turn * 259200000 + conv_id * 60000, 1, turn, null, null, role = 'assistant' from conversations)"""


@query(f"""with {_TWO}, p as (select *, coalesce(last_value(said ignore nulls) over (partition by session order by ms, source, id rows between unbounded preceding and 1 preceding), false) as speaking from r)
 select session, id, speaking, speech and not speaking as passed from p where source = 0""")
def frames_as_of(spark, d):
    """Whether the model speaks at each user frame, and whether the frame passes the echo gate: an as-of join of two tables."""
    ms = lambda df: df.withColumn("ts", F.unix_millis(F.col("ts").cast("timestamp")))
    found = asof.last_before(ms(tables.voice_frames(spark, d)), ms(tables.model_events(spark, d)), "session", "ts", "said")
    speaking = F.coalesce("said", F.lit(False))
    return found.select("session", "id", speaking.alias("speaking"), (F.col("speech") & ~speaking).alias("passed"))


@query(f"""with {_TWO}, c as (select max(ms) as clock from r),
 g as (select *, sum((gap > 172800000)::int) over (partition by session order by ms, source, id) as stretch from (select *, coalesce(ms - lag(ms) over (partition by session order by ms, source, id), 0) as gap from r)),
 p as (select *, coalesce(last_value(said ignore nulls) over (partition by session, stretch order by ms, source, id rows between unbounded preceding and 1 preceding), false) as speaking from g),
 v as (select *, ms - lag(ms) over (partition by session, stretch order by ms, id) as quiet from p where speech),
 t as (select *, sum((quiet is null or quiet > 36000000)::int) over (partition by session, stretch order by ms, id) as turn from v),
 e as (select session, stretch, max(ms) + 172800000 as ms, count(*) filter (speech and not speaking) as passed, count(*) filter (source = 0) as frames, list(energy order by ms, id) filter (energy is not null) as energies from p group by 1, 2),
 k as (select *, list_sort(energies[greatest(1, len(energies) - 149):]) as held from e)
 select session, ms, 'turn_started' as kind, turn::bigint as turn, null::bigint as frames, speaking as barge_in, null::double as floor from t where quiet is null or quiet > 36000000
 union all select session, max(ms) + 36000000, 'turn_complete', turn::bigint, count(*), null, null from t group by session, stretch, turn having max(ms) + 36000000 <= (select clock from c)
 union all select session, ms, 'session_ended', passed, frames, null, held[len(held) * 30 // 100 + 1] from k where ms <= (select clock from c)""")
def session_events(spark, d):
    """Turns, barge-in and silence of sessions of two inputs, by the rule that a stream runs as a state processor with timers."""
    rule = processors.SessionRule(quiet=36_000_000, idle=172_800_000)
    found = processors.run_table(tables.voice_frames(spark, d), tables.model_events(spark, d), rule)
    return found.select("session", F.unix_millis("at").alias("ms"), "kind", "turn", "frames", "barge_in", "floor")


@query(ORACLES["playback_schedule"])
def playback_blocks(spark, d):
    """playback_schedule by the segmented scan: a long session is the work of many tasks."""
    e = tables.table(spark, d, "events").select("event_id", F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrival"), (F.col("value") * 60).alias("duration"))
    return scan.playback(e).select("event_id", "session", F.round("start", 2).alias("start"))


@query(ORACLES["strike_stack"])
def strike_stack_blocks(spark, d):
    op = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 7 == 0), "reset").when(F.col("event_type") == "error", "pop").otherwise("add")
    return scan.stack_depth(tables.table(spark, d, "events").select("event_id", F.col("user_id").alias("interview_id"), "ts", op.alias("op"))).select("event_id", "interview_id", "op", "depth")


@query("""with s as (select event_id % 2 as session, event_id as frame_no, value > 20 as speech from events),
 ch as (select session, frame_no, case when count(*) filter (speech) over (partition by session order by frame_no rows between 4 preceding and current row) = 5 then true when count(*) filter (not speech) over (partition by session order by frame_no rows between 11 preceding and current row) = 12 then false end as c from s)
 select session, frame_no, coalesce(last_value(c ignore nulls) over (partition by session order by frame_no rows unbounded preceding), false) as speaking from ch""")
def latch_blocks(spark, d):
    """The latch over two sessions that hold all events: each is cut into blocks."""
    frames = tables.table(spark, d, "events").select((F.col("event_id") % 2).alias("session"), F.col("event_id").alias("frame_no"), (F.col("value") > 20).cast("int").alias("speech"))
    return scan.latch(frames).select("session", "frame_no", "speaking")


@query("with s as (select l_suppkey % 3 as session, l_orderkey * 10 + l_linenumber as frame_no from lineitem where l_quantity > 45), g as (select *, frame_no - lag(frame_no) over (partition by session order by frame_no) as gap from s) select session, frame_no, sum((gap is null or gap > 30)::int) over (partition by session order by frame_no)::bigint as turn from g")
def turns_blocks(spark, d):
    lines = tables.table(spark, d, "lineitem").where("l_quantity > 45").select((F.col("l_suppkey") % 3).alias("session"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_no"))
    return scan.turns(lines).select("session", "frame_no", "turn")


_LEFT, _RIGHT, _IRIS = [0, 1, 2, 3, 4, 5], [6, 7, 8, 9, 10, 11], (12, 13)


def _dist(a: int, b: int) -> str:
    return f"sqrt(power(e[{2 * a + 1}]::double - e[{2 * b + 1}], 2) + power(e[{2 * a + 2}]::double - e[{2 * b + 2}], 2))"


_RATIO = f"(({_dist(12, 0)}) / ({_dist(0, 3)}) + ({_dist(13, 6)}) / ({_dist(6, 9)})) / 2"


@query(f"""with s as (select vec_id, embedding as e, case vec_id % 11 when 0 then 0 when 1 then 2 else 1 end as faces from embeddings), r as (select vec_id, faces, (({_dist(1, 5)}) + ({_dist(2, 4)})) / (2 * ({_dist(0, 3)})) as ear, {_RATIO} as ratio from s)
 select vec_id, faces, round(case when faces = 0 then 0.0 else ear end, 6)::double as ear, round(case when faces = 0 then 0.0 else ratio end, 6)::double as ratio, case when faces = 0 then 'away' when ratio < 0.35 then 'right' when ratio > 0.65 then 'left' else 'center' end as direction,
 case when faces = 0 then 0.9 when ratio < 0.35 or ratio > 0.65 then 0.8 else 0.9 end::double as confidence, faces <> 1 as looking_away from r""")
def gaze_direction(spark, d):
    points = F.transform(F.sequence(F.lit(0), (F.size("embedding") / 2 - 1).cast("int")), lambda i: F.struct(F.get("embedding", i * 2).cast("double").alias("x"), F.get("embedding", i * 2 + 1).cast("double").alias("y")))
    faces = F.when(F.col("vec_id") % 11 == 0, 0).when(F.col("vec_id") % 11 == 1, 2).otherwise(1)
    rows = tables.table(spark, d, "embeddings").select("vec_id", points.alias("p"), faces.alias("faces"))
    ratio, direction, confidence = geometry.gaze(F.col("p"), _LEFT, _RIGHT, _IRIS, F.col("faces"))
    ear = F.when(F.col("faces") == 0, 0.0).otherwise(geometry.eye_aspect(F.col("p"), _LEFT))
    return rows.select("vec_id", "faces", F.round(ear, 6).alias("ear"), F.round(ratio, 6).alias("ratio"), direction.alias("direction"), confidence.cast("double").alias("confidence"), geometry.looking_away(direction, confidence, F.col("faces")).alias("looking_away"))


def _hashed(salt: int) -> str:
    return f"(('0x' || left(md5('42:' || doc_id || ':' || category || ':' || number || ':{salt}'), 8))::bigint / 4294967296.0::double)"


_LEVELS = " ".join(f"when {k} then {_q(level)}" for k, level in enumerate(questions.WEIGHTS))
_TEMPLATES = ", ".join(f"({_q(c)}, {_q(d)}, {k}, {len(texts)}, {_q(t)})" for c, by in questions.TEMPLATES.items() for d, texts in by.items() for k, t in enumerate(texts))
_SLOTS = ", ".join(f"({_q(c)}, {k})" for c, m in questions.quotas(10).items() for k in range(m))


@query(f"""with r as (select doc_id, case doc_id % 5 {_LEVELS} end as level, {_SKILLS} as s from documents), slots(category, number) as (values {_SLOTS}), t(category, difficulty, k, n, text) as (values {_TEMPLATES}),
 w(level, easy, medium) as (values {", ".join(f"({_q(k)}, {v[0]!r}::double, {v[0] + v[1]!r}::double)" for k, v in questions.WEIGHTS.items())}),
 d as (select doc_id, category, number, s, case when {_hashed(1)} < easy then 'easy' when {_hashed(1)} < medium then 'medium' else 'hard' end as difficulty, {_hashed(2)} as u, {_hashed(3)} as v, {_hashed(4)} as place from r cross join slots join w using (level)),
 c as (select d.*, t.text, case when contains(t.text, '{{skill}}') and len(s) > 0 then s[floor(v * len(s))::int + 1] else '' end as skill_tag from d join t on t.category = d.category and t.difficulty = d.difficulty and t.k = floor(d.u * t.n)::int)
 select doc_id, (row_number() over (partition by doc_id order by place, category, number) - 1)::int as position, category, difficulty, case when skill_tag = '' then text else replace(text, '{{skill}}', skill_tag) end as text, skill_tag from c""")
def question_plan(spark, d):
    """Ten questions for each resume."""
    level = F.element_at(F.array(*(F.lit(x) for x in questions.WEIGHTS)), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = _skilled(spark, d).select("doc_id", level.alias("level"), F.col("s").alias("skills"))
    return questions.plan(rows, 10, key="doc_id", level="level", skills="skills")


@query("""with recursive s as (select event_id, user_id as session, epoch_us(ts) // 1000 as now, case event_type when 'error' then 0 when 'view' then 1 else 2 end as faces, row_number() over (partition by user_id order by ts, event_id) as k from events),
 r as (select event_id, session, k, now as last, case when faces = 2 then 'multiple_faces' end as kind from s where k = 1 union all select s.event_id, s.session, s.k, case when s.faces = 1 or (s.faces = 0 and s.now - r.last > 3600000) then s.now else r.last end,
  case when s.faces = 2 then 'multiple_faces' when s.faces = 0 and s.now - r.last > 3600000 then 'no_face' end from r join s on s.session = r.session and s.k = r.k + 1)
 select event_id, session, kind as event_type from r where kind is not null""")
def no_face_debounce(spark, d):
    faces = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    rows = tables.table(spark, d, "events").select("event_id", F.col("user_id").alias("session"), "ts", faces.alias("faces"))
    return debounce.emitted(rows, 3_600_000)


@query(ORACLES["no_face_debounce"].replace("3600000", "259200000").replace("user_id", "user_id % 7").replace("case event_type when", "case when event_id % 5 > 0 then 0 else case event_type when").replace("else 2 end as faces", "else 2 end end as faces"))
def no_face_chains(spark, d):
    """The debounce with three quiet days: most samples fall into the quiet after another, so that chains are long."""
    faces = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    rows = tables.table(spark, d, "events").select("event_id", (F.col("user_id") % 7).alias("session"), "ts", F.when(F.col("event_id") % 5 > 0, 0).otherwise(faces).alias("faces"))
    return debounce.emitted(rows, 259_200_000)


@query(ORACLES["no_face_debounce"])
def no_face_stateful(spark, d):
    """no_face_debounce as a keyed rule that a stream runs; only samples with one face or none go through it."""
    faces = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    rows = tables.table(spark, d, "events").select("event_id", F.col("user_id").alias("session"), "ts", faces.alias("faces"))
    return state.run_batch(rows, "session", state.debounce_step(3_600_000), state.EMITTED)


# Requests that each kind of endpoint allows.
RATE_LIMITS = {"upload": 10, "interview": 20, "cheating": 50}


@query("""with recursive s as (select event_id, user_id as client, epoch_us(ts) // 1000 as now, case event_type when 'view' then 10 when 'click' then 20 else 50 end as most, row_number() over (partition by user_id order by ts, event_id) as k from events),
 r as (select event_id, client, k, [now] as held, true as allowed from s where k = 1
  union all select s.event_id, s.client, s.k, case when len(list_filter(r.held, lambda t: t > s.now - 1728000000)) < s.most then list_append(list_filter(r.held, lambda t: t > s.now - 1728000000), s.now) else list_filter(r.held, lambda t: t > s.now - 1728000000) end,
   len(list_filter(r.held, lambda t: t > s.now - 1728000000)) < s.most from r join s on s.client = r.client and s.k = r.k + 1)
 select event_id, client, allowed from r""")
def rate_limit(spark, d):
    """The three kinds of requests share a client's history; the hour is scaled to twenty days, as the events are that far apart."""
    kind = F.when(F.col("event_type") == "view", "upload").when(F.col("event_type") == "click", "interview").otherwise("cheating")
    rows = tables.table(spark, d, "events").select("event_id", F.col("user_id").alias("client"), "ts", kind.alias("kind"))
    return state.run_batch(rows, "client", state.rate_step(RATE_LIMITS, 1_728_000_000), state.ALLOWED)


@query("select event_id, user_id as client, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as attempts from events")
def rate_attempts(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000_000, 0)
    return tables.table(spark, d, "events").withColumn("at", at).select("event_id", F.col("user_id").alias("client"), F.count(F.lit(1)).over(w).alias("attempts"))


@query(f"with {_A} select event_id, interview_id, strike_number, strike_number = 2 as terminates from a where strike_number <= 2")
def strikes_stateful(spark, d):
    return state.run_batch(tables.violations(spark, d), "interview_id", state.strike_step(2), state.STRIKES)


@query("select event_type, time_bucket(interval 1 day, ts) as start, time_bucket(interval 1 day, ts) + interval 1 day as \"end\", count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def tumbling_windows(spark, d):
    return state.windows(tables.table(spark, d, "events"), "tumbling")


@query("""with s as (select event_type, value, unnest([time_bucket(interval 12 hours, ts), time_bucket(interval 12 hours, ts) - interval 12 hours]) as start from events) select event_type, start, start + interval 1 day as "end", count(*) as n, round(sum(value), 2) as total from s group by 1, 2""")
def sliding_windows(spark, d):
    return state.windows(tables.table(spark, d, "events"), "sliding")


@query("""with g as (select *, ts >= lag(ts) over (partition by event_type order by ts) + interval 2 hours or lag(ts) over (partition by event_type order by ts) is null as new from events), s as (select *, sum(new::int) over (partition by event_type order by ts, event_id) as k from g)
 select event_type, min(ts) as start, max(ts) + interval 2 hours as "end", count(*) as n, round(sum(value), 2) as total from s group by event_type, k""")
def session_windows(spark, d):
    return state.windows(tables.table(spark, d, "events"), "session")


_RAW = """case event_type when 'view' then '{"type": "audio", "data": "' || event_id || '"}' when 'click' then '{"type": "text", "text": "event ' || event_id || '"}' when 'error' then '{"type": "text", "text' when 'signup' then '{"type": "ping"}'
 else case when event_id % 2 = 0 then '{"type": "cheating_detected", "event_type": "tab_switch"}' else '{"type": "cheating_detected", "event_type": "no_face", "confidence": 0.8}' end end"""


@query(f"""with m as (select event_id, {_RAW} as raw from events), p as (select *, json_valid(raw) as ok, case when json_valid(raw) then raw end as j from m)
 select event_id, case when not ok then 'error' when j->>'$.type' in ('audio', 'text', 'cheating_detected', 'end_interview') then j->>'$.type' else 'ignored' end as route, j->>'$.type' as type, j->>'$.data' as data, j->>'$.text' as text, j->>'$.event_type' as event_type,
 case when j->>'$.type' = 'cheating_detected' then coalesce((j->>'$.confidence')::double, 0.0) end as confidence from p""")
def message_demux(spark, d):
    return messages.demux(tables.table(spark, d, "events").select("event_id", F.expr(_RAW).alias("raw"))).drop("raw")


@query(f"""with {_FG}, pc as (select session, frame_no, list_transform(x, lambda v: trunc(v * 32767)::int) as p from gx)
 select session, frame_no, to_base64(unhex(array_to_string(list_transform(p, lambda v: printf('%02x%02x', v & 255, (v >> 8) & 255)), ''))) as data, len(p)::int as n, round(list_sum(list_transform(p, lambda v: v / 32768.0::double)), 6) as total from pc""")
def base64_audio(spark, d):
    data = messages.pcm_base64(audio.pcm16(audio.gained(F.col("x"))))
    f = tables.frames(spark, d).select("session", "frame_no", data.alias("data")).withColumn("y", audio.from_pcm16(messages.base64_pcm(F.col("data"))))
    return f.select("session", "frame_no", "data", F.size("y").alias("n"), F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query(f"""with {_E}, st as (select *, coalesce(last_value(case event_type when 'view' then true when 'purchase' then false end ignore nulls) over (partition by session order by frame_no rows between unbounded preceding and 1 preceding), false) as speaking from e)
 select session, count(*) as passed, min(frame_no) as first_frame, max(frame_no) as last_frame from st where speech and not speaking group by 1""")
def echo_gate(spark, d):
    kept = messages.echo_gate(_event_frames(spark, d)).groupBy("session")
    return kept.agg(F.count(F.lit(1)).alias("passed"), F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"))


@query(f"""with {_FG}, src as (select session, frame_no, x from gx), z as (select session, frame_no, {_ZCR} as zcr from src), h as (select *, list(zcr) over (partition by session order by frame_no rows between 49 preceding and current row) as h from z)
 select session, frame_no, round(case when len(h) >= 20 then list_sort(h)[len(h) // 4 + 1] end, 6) as zcr_floor from h""")
def zero_crossing_floor(spark, d):
    z = tables.frames(spark, d).select("session", "frame_no", audio.zero_crossings(audio.gained(F.col("x"))).alias("zcr"))
    return turns.crossing_floor(z).select("session", "frame_no", F.round("zcr_floor", 6).alias("zcr_floor"))


_SPAN = """t as (select o_orderkey as interview_id, case when o_orderstatus <> 'P' then o_orderdate end as a, case when o_orderstatus = 'F' then e end as b from orders left join (select l_orderkey, max(l_shipdate) as e from lineitem group by 1) on l_orderkey = o_orderkey)"""


def _timed(spark, d):
    ends = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("e"))
    o = tables.table(spark, d, "orders").join(ends, "o_orderkey", "left")
    return o.select(F.col("o_orderkey").alias("interview_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("a"), F.when(F.col("o_orderstatus") == "F", F.col("e")).alias("b"))


@query(f"""with {_SPAN} select interview_id, round((epoch_us(b) - epoch_us(a)) / 1e6, 3) as seconds, case when a is null then 0.0::double else round((epoch_us(coalesce(b, timestamp '2024-01-01')) - epoch_us(a)) / 1e6, 3) end as open_seconds, floor((epoch_us(b) - epoch_us(a)) / 1e6 / 60 + 0.5)::bigint as minutes from t""")
def interview_durations(spark, d):
    a, b = F.col("a"), F.col("b")
    seconds = lifecycle.duration_seconds(a, b)
    return _timed(spark, d).select("interview_id", F.round(seconds, 3).alias("seconds"), F.round(lifecycle.open_duration_seconds(a, b, F.lit("2024-01-01")), 3).alias("open_seconds"), lifecycle.shown_minutes(seconds).alias("minutes"))


@query(f"""with {_SPAN}, n as (select count(*) as n from t), e as (select count(*) as n, count(*) filter (not (value / 100 between 0 and 1)) as r, count(*) filter (event_type not in ('view', 'click', 'error')) as k, count(*) filter (value >= 60 and event_id % 5 = 0) as u, count(*) filter (event_id % 4 = 3 or event_id * 2000 > 10485760) as f from events)
 select 'end_after_start' as rule, n as checked, (select count(*) from t where b < a) as broken from n union all select 'confidence_range', n, r from e union all select 'event_kind', n, k from e union all select 'strike_numbered', n, u from e union all select 'upload', n, f from e""")
def data_quality(spark, d):
    e = tables.table(spark, d, "events")
    spans = quality.broken(_timed(spark, d), {"end_after_start": quality.ordered(F.col("a"), F.col("b"))})
    return spans.unionByName(quality.broken(e, {"confidence_range": quality.within(F.col("value") / 100, 0, 1), "event_kind": quality.one_of(F.col("event_type"), ["view", "click", "error"]), "strike_numbered": quality.numbered(F.col("value") >= 60, F.when(F.col("event_id") % 5 != 0, F.lit(1))), "upload": quality.upload(F.concat(F.lit("cv."), F.element_at(F.array(F.lit("pdf"), F.lit("DOCX"), F.lit("txt"), F.lit("exe")), (F.col("event_id") % 4 + 1).cast("int"))), F.col("event_id") * 2000)}))


_NAMED = "case event_type when 'error' then 'DatabaseError' when 'view' then 'ValidationError' when 'signup' then 'OperationalError' when 'click' then 'KeyError' else 'Exception' end"


@query(f"""select kind, status, code, short, count(*) as n from (select {_NAMED} as kind, case when event_type in ('error', 'signup') then 503 when event_type = 'view' then 400 else 500 end as status, case when event_type in ('error', 'signup') then 'database_error' when event_type = 'view' then 'validation_error' else 'internal_error' end as code,
 case event_type when 'error' then 'database' when 'view' then 'validation' when 'signup' then 'operational' when 'click' then 'key' else 'unknown_error' end as short from events) group by 1, 2, 3, 4""")
def error_classes(spark, d):
    e = tables.table(spark, d, "events").select(F.expr(_NAMED).alias("kind"))
    return e.groupBy("kind", lifecycle.error_class(F.col("kind")).alias("c"), lifecycle.error_code(F.col("kind")).alias("short")).agg(F.count(F.lit(1)).alias("n")).select("kind", "c.*", "short", "n")


_LOG = "select event_id, user_id as interview_id, ts, case event_type when 'view' then 'start' when 'error' then 'terminate' else 'end' end as command from events where event_type in ('view', 'error', 'purchase')"


@query(f"""with recursive c as (select *, row_number() over (partition by interview_id order by ts, event_id) as k from ({_LOG})),
 r as (select interview_id, 0::bigint as k, null::bigint as event_id, 'pending' as status, null::varchar as refused from (select distinct interview_id from c)
  union all select c.interview_id, c.k, c.event_id, case when c.command = 'start' and r.status = 'pending' then 'in_progress' when c.command <> 'start' and r.status = 'in_progress' then (case c.command when 'terminate' then 'terminated' else 'completed' end) else r.status end,
  case when not (c.command = 'start' and r.status = 'pending' or c.command <> 'start' and r.status = 'in_progress') then 'Cannot ' || (case c.command when 'start' then 'start' else 'end' end) || ' interview with status: ' || r.status end from r join c on c.interview_id = r.interview_id and c.k = r.k + 1)
 select event_id, interview_id, status, refused from r where k > 0""")
def lifecycle_commands(spark, d):
    e = tables.table(spark, d, "events").where(F.col("event_type").isin("view", "error", "purchase"))
    command = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "error", "terminate").otherwise("end")
    return lifecycle.commands(e.select("event_id", F.col("user_id").alias("interview_id"), "ts", command.alias("command"))).select("event_id", "interview_id", "status", "refused")


@query("""select o_orderkey as interview_id, coalesce(len(q), 0)::int as questions, to_json(struct_pack(id := o_orderkey, status := o_orderstatus, questions := coalesce(q, [])))::varchar as body
 from orders left join (select l_orderkey, list(struct_pack(l_linenumber, l_partkey) order by l_linenumber, l_partkey) as q from lineitem group by 1) on l_orderkey = o_orderkey""")
def interview_response(spark, d):
    """Each interview with its questions, as the JSON that a client gets."""
    o = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    q = tables.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "id")
    nested = lifecycle.children(o, q, "id", ["l_linenumber", "l_partkey"], [], "questions")
    return nested.select(F.col("id").alias("interview_id"), F.size("questions").alias("questions"), messages.reply("id", "status", "questions").alias("body"))


@query("""with c as (select c_custkey, c_name, c_mktsegment from customer), u as (select c_custkey, c_name || ' II' as c_name, 'CHANGED' as c_mktsegment from c where c_custkey % 10 = 0 union all select c_custkey + 1000000, c_name, 'NEW' from c where c_custkey % 25 = 0)
 select * from c where c_custkey not in (select c_custkey from u) union all select * from u""")
def candidate_upsert(spark, d):
    c = tables.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changed = c.where("c_custkey % 10 = 0").select("c_custkey", F.concat("c_name", F.lit(" II")).alias("c_name"), F.lit("CHANGED").alias("c_mktsegment"))
    new = c.where("c_custkey % 25 = 0").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), "c_name", F.lit("NEW").alias("c_mktsegment"))
    return lifecycle.upsert(c, changed.unionByName(new), "c_custkey")


@query(f"""with s as (select doc_id, {_SKILLS} as s from documents) select doc_id, array_to_string(s[1:15], '|') || case when len(s) > 15 then '|+' || (len(s) - 15) || ' more' else '' end as shown, case when len(s) > 0 then array_to_string(s[1:10], ', ') else 'Not specified' end as prompt,
 case when len(s) > 0 then replace('How do you use {{skill}}?', '{{skill}}', s[1]) else 'How do you use {{skill}}?' end as question from s""")
def skill_texts(spark, d):
    s = _skilled(spark, d)
    return s.select("doc_id", F.array_join(questions.shown_skills(F.col("s")), "|").alias("shown"), questions.prompt_skills(F.col("s")).alias("prompt"), questions.fill(F.lit("How do you use {skill}?"), F.get("s", F.lit(0))).alias("question"))


@query("select event_id, case when event_id % 3 = 2 then 'plain ```' else event_type end as category from events")
def fenced_replies(spark, d):
    """Model replies in code fences, parsed; those without a fence at their start stay as they are."""
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(' ```json\n[{"category": "'), "event_type", F.lit('"}]\n```\n'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('[{"category": "'), "event_type", F.lit('"}]'))).otherwise("plain ``` ")
    rows = tables.table(spark, d, "events").select("event_id", messages.unfenced(body).alias("reply"))
    return rows.select("event_id", F.coalesce(F.get(F.from_json("reply", "array<struct<category:string>>"), F.lit(0))["category"], "reply").alias("category"))


@query("""with e as (select user_id as session, event_id, ts, case event_type when 'purchase' then 'end_interview' when 'view' then 'audio' else 'text' end as type from events),
 g as (select *, coalesce(ts >= lag(ts) over (partition by session order by ts, event_id) + interval 6 hours, true) as new from e), s as (select *, sum(new::int) over (partition by session order by ts, event_id) as k from g)
 select session, min(ts) as start, max(ts) + interval 6 hours as ended_at, count(*) as messages, last(type order by ts, event_id) as last_type from s group by session, k having last(type order by ts, event_id) <> 'end_interview'""")
def disconnected_sessions(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "end_interview").when(F.col("event_type") == "view", "audio").otherwise("text")
    return state.disconnects(tables.table(spark, d, "events").select(F.col("user_id").alias("session"), "event_id", "ts", kind.alias("type")), "6 hours")
