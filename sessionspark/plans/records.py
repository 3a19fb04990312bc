"""Queries over records: one by key, lists, appended and updated rows, projections of each entity, documents' bytes, client messages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import audio, extraction, geometry
from ..operators import lifecycle, messages, strikes
from ..sources import documents, tables
from .queries import _A, _F, _I, _RMS, _SKILLS, _V, AS_OF_YEAR, query


@query("select doc_id, source, n_chars, text from documents where doc_id = 7")
def resume_by_id(spark, d):
    return lifecycle.get(tables.table(spark, d, "documents"), "doc_id", 7).select("doc_id", "source", "n_chars", "text")


@query(f"with {_I} select interview_id, resume_id, status, created_at from i where resume_id = 7 and status = 'completed' order by created_at desc, interview_id desc limit 1")
def interview_first(spark, d):
    """The first of a candidate's interviews of one status, in the table's order (latest first)."""
    found = lifecycle.listing(tables.interviews(spark, d), filters={"resume_id": 7, "status": "completed"}, order=[F.desc("created_at"), F.desc("interview_id")], page=1)
    return found.select("interview_id", "resume_id", "status", "created_at")


@query(f"with {_I} select row_number() over (order by created_at desc, interview_id) as place, interview_id, candidate_name, status from (select interview_id, c_name as candidate_name, status, created_at from i join customer on resume_id = c_custkey where status = 'pending' and (contains(lower(c_name), '001') or contains(lower(status), '001')) order by created_at desc, interview_id limit 50)")
def admin_list(spark, d):
    """A page of a filtered, searched and ordered list."""
    rows = tables.interviews(spark, d).join(tables.candidates(spark, d), "resume_id")
    page = lifecycle.listing(rows, filters={"status": "pending"}, columns=["candidate_name", "status"], text="001", order=[F.desc("created_at"), F.asc("interview_id")], page=50)
    listed = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("k"), "interview_id", "candidate_name", "status")))  # of a page
    return page.agg(listed.alias("l")).select(F.posexplode("l").alias("place", "r")).select((F.col("place") + 1).cast("long").alias("place"), "r.interview_id", "r.candidate_name", "r.status")


@query(f"with {_V} select event_id, interview_id, event_type, confidence::double as confidence, null::varchar as details from v union all select event_id + 1000000000, interview_id, 'multiple_faces', 0.9::double, '{{\"count\":2}}' from v where event_id % 50 = 0")
def event_append(spark, d):
    """Reports with new ones appended, which have details."""
    v = tables.violations(spark, d).select("event_id", "interview_id", "event_type", "confidence").withColumn("details", F.lit(None).cast("string"))
    new = v.where("event_id % 50 = 0").select((F.col("event_id") + 1_000_000_000).alias("event_id"), "interview_id", F.lit("multiple_faces").alias("event_type"), F.lit(0.9).alias("confidence"), F.lit('{"count":2}').alias("details"))
    return lifecycle.append(v, new)


@query(f"with {_I} select interview_id, resume_id, case when interview_id % 3 = 0 and status = 'in_progress' then 'completed' else status end as status, case when interview_id % 3 = 0 and status = 'in_progress' then timestamp '2024-01-01' end as end_time from i")
def interview_update(spark, d):
    """Interviews of which some get a new status and end; the other columns stay."""
    i = tables.interviews(spark, d).select("interview_id", "resume_id", "status", F.lit(None).cast("timestamp_ntz").alias("end_time"))
    ended = i.where("interview_id % 3 = 0 and status = 'in_progress'").select("interview_id", F.lit("completed").alias("status"), F.expr("timestamp_ntz '2024-01-01'").alias("end_time"))
    return lifecycle.update_fields(i, ended, "interview_id", ["status", "end_time"])


@query(f"""select doc_id as id, 'resume_' || doc_id || '.txt' as original_filename, left(regexp_extract(text, '{extraction.EMAIL}', 0), 254) as email, left(regexp_extract(text, '{extraction.PHONE}', 0), 50) as phone, 0.0::double as experience_years,
 array_to_string({_SKILLS}, ',') as skills, array_to_string(regexp_extract_all(text, '{extraction.DEGREE.replace("'", "''")}', 1)[1:3], '|') as education, '' as work_history from documents""")
def resume_records(spark, d):
    """The columns that a resume's endpoint gives, arrays as texts."""
    t = F.col("text")
    docs = extraction.with_skills(tables.table(spark, d, "documents").select("doc_id", "text"))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("resume_"), "doc_id", F.lit(".txt")).alias("original_filename"),
        extraction.email(t).alias("email"),
        extraction.phone(t).alias("phone"),
        extraction.experience_years(t, AS_OF_YEAR).alias("experience_years"),
        F.array_join("skills", ",").alias("skills"),
        F.array_join(extraction.education(t), "|").alias("education"),
        F.array_join(extraction.job_spans(t), "|").alias("work_history"),
    )


@query(f"""with {_A} select a.event_id as id, a.event_type, round(a.confidence, 6) as confidence, e.props as details, a.strike_number <= 2 as resulted_in_strike, case when a.strike_number <= 2 then a.strike_number end as strike_number,
 strftime(a.ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(a.ts) % 1000000 = 0 then '' else '.' || lpad((epoch_us(a.ts) % 1000000)::varchar, 6, '0') end as timestamp from a join events e using (event_id)""")
def event_records(spark, d):
    """The columns that a report's endpoint gives; times are ISO texts."""
    t = strikes.timeline(tables.violations(spark, d), 2**31 - 1)
    rows = t.join(tables.table(spark, d, "events").select("event_id", F.col("props").alias("details")), "event_id")
    struck = F.col("strike_number") <= 2
    return rows.select(F.col("event_id").alias("id"), "event_type", F.round("confidence", 6).alias("confidence"), "details", struck.alias("resulted_in_strike"), F.when(struck, F.col("strike_number")).alias("strike_number"), lifecycle.iso(F.col("ts")).alias("timestamp"))


@F.arrow_udf(T.BinaryType())
def _as_docx(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts as docx files, a paragraph for each line."""

    def one(text: str) -> bytes:
        out = io.BytesIO()
        body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{documents.WORD}"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    for column in texts:
        yield from documents.by_pieces(column, one, pa.binary())


@query("select doc_id, case when doc_id % 2 = 0 and not regexp_matches(text, '[\\x00-\\x08\\x0B-\\x1F]') then 'docx' else 'txt' end as suffix, length(text)::bigint as n_chars, md5(text) as digest from documents")
def document_texts(spark, d):
    """Documents written as txt and docx bytes and read again by their suffix (control characters have no place in docx)."""
    suffix = F.when((F.col("doc_id") % 2 == 0) & ~F.col("text").rlike(r"[\x00-\x08\x0B-\x1F]"), "docx").otherwise("txt")
    files = tables.table(spark, d, "documents").select("doc_id", suffix.alias("suffix"), "text")
    files = files.select("doc_id", "suffix", F.when(F.col("suffix") == "docx", _as_docx(F.when(F.col("suffix") == "docx", F.col("text")))).otherwise(F.encode("text", "UTF-8")).alias("content"))
    found = files.select("doc_id", "suffix", documents.document_text(F.col("suffix"), F.col("content")).alias("text"))
    return found.select("doc_id", "suffix", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"with {_F}, src as (select session, frame_no, x0 as x from f) select session, frame_no, len(x)::int as n, round({_RMS}, 6) as energy from src")
def binary_frames(spark, d):
    """Frames as the little-endian 32-bit floats that clients send, decoded again."""
    pack = F.pandas_udf(lambda s: s.map(lambda x: x.astype("<f4").tobytes(), na_action="ignore"), T.BinaryType())
    f = tables.table(spark, d, "embeddings").select(F.col("label").alias("session"), F.col("vec_id").alias("frame_no"), messages.float32_samples(pack("embedding")).alias("x"))
    return f.select("session", "frame_no", F.size("x").alias("n"), F.round(audio.energy(F.col("x")), 6).alias("energy"))


@query("""with f as (select label as session, vec_id as frame_no, list_transform(embedding, lambda x: x::double * 8) as x from embeddings), p as (select *, list_max(list_transform(x, lambda v: abs(v))) as top from f),
 l as (select session, frame_no, list_transform(x, lambda v: trunc((case when top > 1 then v / top else v end) * 32767)) as w from p) select session, frame_no, list_sum(w)::bigint as pcm_sum, list_max(list_transform(w, lambda v: abs(v)))::bigint as pcm_peak from l""")
def limited_pcm(spark, d):
    """Samples over full scale, divided by their peak before they become 16-bit numbers."""
    loud = tables.frames(spark, d).select("session", "frame_no", audio.pcm16_limited(F.transform("x", lambda v: v * 8)).alias("p"))
    return loud.select("session", "frame_no", F.aggregate("p", F.lit(0).cast("long"), lambda s, v: s + v).alias("pcm_sum"), F.array_max(F.transform("p", F.abs)).cast("long").alias("pcm_peak"))


@query("""select event_id, event_id % 4 in (0, 1) as readable, case when event_id % 4 in (0, 1) then null else 'away' end as direction, case when event_id % 4 in (0, 1) then null else 0.0 end::double as confidence, case when event_id % 4 in (0, 1) then (7 + length(props))::int end as n_bytes from events""")
def image_frames(spark, d):
    """Camera frames as base64 texts; what is no image looks away with no confidence."""
    e = tables.table(spark, d, "events")
    image = F.base64(F.concat(F.unhex(F.lit("FFD8FFE0000000")), F.col("props").cast("binary")))
    image = F.regexp_replace(image, r"[\r\n]", "")
    sent = F.when(F.col("event_id") % 4 == 0, image).when(F.col("event_id") % 4 == 1, F.concat(F.lit("data:image/jpeg;base64,"), image)).when(F.col("event_id") % 4 == 2, "no image!").otherwise(F.regexp_replace(F.base64(F.col("props").cast("binary")), r"[\r\n]", ""))
    direction, confidence, _ = geometry.unreadable()
    raw = F.col("raw")
    return e.select("event_id", messages.image_bytes(sent).alias("raw")).select("event_id", raw.isNotNull().alias("readable"), F.when(raw.isNull(), direction).alias("direction"), F.when(raw.isNull(), confidence).alias("confidence"), F.length(raw).alias("n_bytes"))


@query(f"""with {_A} select interview_id, strike_number, case when strike_number >= 3 then '{{"type":"terminated","message":"{strikes.SOCKET_TERMINATED}","strikes":' || strike_number || '}}'
 else '{{"type":"warning","message":"' || case strike_number when 1 then '{strikes.SOCKET_WARNINGS[1]}' else '{strikes.SOCKET_WARNINGS[2]}' end || '","strikes":' || strike_number || ',"max_strikes":3}}' end as body from a where strike_number <= 3""")
def client_messages(spark, d):
    return messages.strike_messages(strikes.timeline(tables.violations(spark, d), 3), 3)


@query("""select event_id, case when event_type = 'error' then '{"type":"error","message":"' else '{"type":"transcript","text":"' end || event_type || ' ' || event_id || '"}' as body from events""")
def text_messages(spark, d):
    said = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))
    body = F.when(F.col("event_type") == "error", messages.text_message("error", "message", said)).otherwise(messages.text_message("transcript", "text", said))
    return tables.table(spark, d, "events").select("event_id", body.alias("body"))
