"""Queries over stored forms: recordings, key-hashed tables, links by LATERAL, details of any shape, full records."""

from __future__ import annotations

import uuid

import pyspark.sql.types as T
from pyspark.sql import functions as F

from ..functions import audio, extraction
from ..operators import lifecycle, messages, quality, questions, variants
from ..sources import documents, keyed, links, recordings, tables
from ..sources.stored import shared_folder
from .queries import _A, _F, _RMS, _SKILLS, _q, AS_OF_YEAR, ORACLES, query


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"with {_F}, src as (select session, frame_no, x0 as x from f) select session, frame_no, len(x)::int as n, round({_RMS}, 6) as energy from src")
def recorded_frames(spark, d):
    """Frames written as recordings of binary messages and read again by byte ranges."""
    recordings.register(spark)
    pack = F.pandas_udf(lambda s: s.map(lambda x: x.astype("<f4").tobytes(), na_action="ignore"), T.BinaryType())
    path = _path(spark, "recordings")
    rows = tables.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("session"), F.col("vec_id").cast("long").alias("seq"), F.lit("binary").alias("kind"), pack("embedding").alias("payload"))
    rows.write.format("recording").option("path", path).mode("append").save()
    x = messages.float32_samples("payload")
    found = spark.read.format("recording").option("rangeBytes", 1 << 20).load(path).where("kind = 'binary'").select(F.col("session").cast("int").alias("session"), F.col("seq").alias("frame_no"), x.alias("x"))
    return found.select("session", "frame_no", F.size("x").alias("n"), F.round(audio.energy(F.col("x")), 6).alias("energy"))


@query(ORACLES["candidate_upsert"])
def candidate_copy_on_write(spark, d):
    """candidate_upsert into a key-hashed table, of which only the folders of changed keys are written anew."""
    c = tables.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    table = keyed.KeyedTable(spark, _path(spark, "candidates"), "c_custkey", 16)
    table.create(c)
    table.upsert(c.where("c_custkey % 10 = 0").select("c_custkey", F.concat("c_name", F.lit(" II")).alias("c_name"), F.lit("CHANGED").alias("c_mktsegment")))
    table.upsert(c.where("c_custkey % 25 = 0").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), "c_name", F.lit("NEW").alias("c_mktsegment")))
    return table.rows()


_TYPE = "case " + " ".join(f"when {' or '.join(f'contains(lower(url), {_q(m)})' for m in marks)} then {_q(kind)}" for kind, marks in extraction.LINK_RULES) + " else 'other' end"


@query(f"""with h as (select page_id // 10 as document_id, row_number() over (partition by page_id // 10 order by page_id) as page, regexp_extract_all(html, 'href="([^"]*)"', 1) as hrefs from pages),
 l as (select document_id, page::int as page, unnest(hrefs) as url, generate_subscripts(hrefs, 1) as k from h) select document_id, url, {_TYPE} as type, page, count(*) as n from l group by 1, 2, 3, 4""")
def document_links(spark, d):
    """Links of documents of ten pages, with the page that each is on, by the table function from SQL."""
    links.register(spark)
    parts = F.array_sort(F.collect_list(F.struct("page_id", "html")))  # ten pages
    docs = tables.table(spark, d, "pages").groupBy(F.expr("page_id div 10").alias("document_id")).agg(parts.alias("p"))
    docs = docs.select("document_id", F.array_join(F.transform("p", lambda p: p["html"]), links.PAGE_MARK).alias("markup"))
    return spark.sql("select document_id, url, type, page, count(*) as n from {docs}, lateral document_links(markup) group by all", docs=docs)


@query("""select event_id, case event_id % 5 when 2 then null else regexp_extract(props, '[0-9]+')::bigint end as k, case event_id % 5 when 2 then 'broken' when 1 then 'OBJECT<k: STRING>' when 3 then 'OBJECT<k: ARRAY<BIGINT>>' when 4 then 'OBJECT<extra: OBJECT<k: BIGINT>>' else 'OBJECT<k: BIGINT>' end as shape from events""")
def details_of_any_shape(spark, d):
    """Details whose shape differs by row, and broken ones kept apart."""
    n = F.regexp_extract("props", "[0-9]+", 0)
    sent = F.when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"k":"'), n, F.lit('"}'))).when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"k":'), n)).when(F.col("event_id") % 5 == 3, F.concat(F.lit('{"k":['), n, F.lit("]}"))).when(F.col("event_id") % 5 == 4, F.concat(F.lit('{"extra":{"k":'), n, F.lit("}}"))).otherwise(F.col("props"))
    rows = variants.parsed(tables.table(spark, d, "events").select("event_id", sent.alias("details")), "details")
    k = variants.first_of(F.col("value"), ["$.k", "$.k[0]", "$.extra.k"], "bigint")
    return rows.select("event_id", k.alias("k"), F.when(F.col("broken"), "broken").otherwise(F.schema_of_variant("value")).alias("shape"))


@query("""select event_type, count(*) filter (event_id % 5 <> 2) as parsed, count(*) filter (event_id % 5 = 2) as broken, 'OBJECT<extra: OBJECT<k: BIGINT>, k: VARIANT>' as shape from events group by 1""")
def details_shapes(spark, d):
    """The one shape that holds all details of a type: where types clash, VARIANT."""
    n = F.regexp_extract("props", "[0-9]+", 0)
    sent = F.when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"k":"'), n, F.lit('"}'))).when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"k":'), n)).when(F.col("event_id") % 5 == 3, F.concat(F.lit('{"k":['), n, F.lit("]}"))).when(F.col("event_id") % 5 == 4, F.concat(F.lit('{"extra":{"k":'), n, F.lit("}}"))).otherwise(F.col("props"))
    return variants.shapes(tables.table(spark, d, "events").select("event_type", sent.alias("details")), "event_type", "details")


_NAME = r"coalesce(list_filter(list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1:5], lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '' and len(string_split_regex(l, '\s+')) <= 4 and not regexp_matches(l, '\d') and not contains(lower(l), 'resume') and not contains(lower(l), 'cv') and not contains(lower(l), 'curriculum'))[1], '')"
_FULL = f"""full_resume as (select doc_id as id, 'resume_' || doc_id || '.txt' as original_filename, left({_NAME}, 255) as candidate_name, left(regexp_extract(text, '{extraction.EMAIL}', 0), 254) as email, left(regexp_extract(text, '{extraction.PHONE}', 0), 50) as phone, 0.0::double as experience_years,
 {_SKILLS} as skills, regexp_extract_all(text, '{extraction.DEGREE.replace("'", "''")}', 1)[1:3] as education, strftime(timestamp '2024-01-01' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S') as created_at from documents)"""


def _resumes(spark, d):
    """The eleven columns that a resume's endpoint gives."""
    t = F.col("text")
    docs = extraction.with_skills(tables.table(spark, d, "documents").select("doc_id", "text"))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("resume_"), "doc_id", F.lit(".txt")).alias("original_filename"), extraction.name(t).alias("candidate_name"), extraction.email(t).alias("email"), extraction.phone(t).alias("phone"), extraction.experience_years(t, AS_OF_YEAR).alias("experience_years"),
        "skills", extraction.education(t).alias("education"), extraction.job_spans(t).alias("work_history"), lifecycle.iso(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))).alias("created_at"),
    )
    # Of a text file there are no links.
    parsed = F.to_json(F.struct(F.col("candidate_name").alias("name"), "email", "phone", "experience_years", "skills", "education", "work_history", F.array().cast("array<string>").alias("links")))
    return rows.withColumn("parsed_data", parsed)


@query(f"""with {_FULL} select id, original_filename, candidate_name, email, phone, experience_years, array_to_string(skills, ',') as skills, array_to_string(education, '|') as education, '' as work_history,
 json_object('name', candidate_name, 'email', email, 'phone', phone, 'experience_years', experience_years, 'skills', skills, 'education', education, 'work_history', []::varchar[], 'links', []::varchar[])::varchar as parsed_data, created_at from full_resume""")
def full_resume_records(spark, d):
    return _resumes(spark, d).withColumn("skills", F.array_join("skills", ",")).withColumn("education", F.array_join("education", "|")).withColumn("work_history", F.array_join("work_history", "|"))


@query(f"""with {_FULL}, {_A}, st as (select interview_id, least(count(*), 2) as strikes from a group by 1), e as (select l_orderkey, max(l_shipdate) as e from lineitem group by 1),
 i as (select o_orderkey as id, o_custkey as resume_id, o_orderpriority as experience_level, case o_orderstatus when 'P' then 'pending' when 'O' then 'in_progress' else 'completed' end as status, case when o_orderstatus <> 'P' then o_orderdate end as start_time, case when o_orderstatus = 'F' then e end as end_time, o_orderdate as created_at
  from orders left join e on l_orderkey = o_orderkey)
 select i.id, case when f.id is not null then json_object('id', f.id, 'original_filename', original_filename, 'email', email, 'phone', phone, 'skills', skills, 'created_at', f.created_at)::varchar end as resume, experience_level, case when strikes >= 2 then 'terminated' else status end as status,
 strftime(start_time, '%Y-%m-%dT%H:%M:%S') as start_time, strftime(end_time, '%Y-%m-%dT%H:%M:%S') as end_time, coalesce(strikes, 0)::bigint as strikes, case when strikes >= 2 then 'Interview terminated after 2 strikes (maximum: 2).' else '' end as termination_reason, round((epoch_us(end_time) - epoch_us(start_time)) / 1e6, 3) as duration_seconds, strftime(i.created_at, '%Y-%m-%dT%H:%M:%S') as created_at
 from i left join full_resume f on f.id = resume_id left join st on st.interview_id = i.id""")
def full_interview_records(spark, d):
    """The ten columns that an interview's endpoint gives, its resume nested."""
    from ..operators import strikes

    ends = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("interview_id")).agg(F.max("l_shipdate").alias("e"))
    i = tables.interviews(spark, d).join(ends, "interview_id", "left")
    counted = strikes.summary(tables.violations(spark, d), 2).select("interview_id", F.col("strikes").alias("n"))
    nested = ["id", "original_filename", "email", "phone", "skills", "created_at"]
    resumes = _resumes(spark, d).select(F.col("id").alias("resume_id"), F.struct(*nested).alias("resume"))
    rows = i.join(resumes, "resume_id", "left").join(counted, "interview_id", "left")
    over = F.coalesce(F.col("n") >= 2, F.lit(False))
    start, end = F.when(F.col("status") != "pending", F.col("created_at")), F.when(F.col("status") == "completed", F.col("e"))
    return rows.select(
        F.col("interview_id").alias("id"), F.to_json("resume").alias("resume"), "experience_level", F.when(over, "terminated").otherwise(F.col("status")).alias("status"), lifecycle.iso(start).alias("start_time"), lifecycle.iso(end).alias("end_time"), F.coalesce("n", F.lit(0)).cast("long").alias("strikes"),
        F.when(over, "Interview terminated after 2 strikes (maximum: 2).").otherwise("").alias("termination_reason"), F.round(lifecycle.duration_seconds(start, end), 3).alias("duration_seconds"), lifecycle.iso(F.col("created_at")).alias("created_at"),
    )


@query("""select doc_id, case doc_id % 4 when 0 then 'txt' when 1 then 'docx' when 2 then 'exe' else 'PDF' end as suffix, octet_length(encode(text))::bigint * 1000 as n_bytes, doc_id % 4 <> 2 and octet_length(encode(text))::bigint * 1000 <= 10485760 as accepted from documents""")
def upload_checks(spark, d):
    """Uploads by type and size; the sizes are a thousand times those of the texts."""
    suffix = F.element_at(F.array(*(F.lit(x) for x in ("txt", "docx", "exe", "PDF"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = tables.table(spark, d, "documents").select("doc_id", suffix.alias("suffix"), (F.octet_length("text").cast("long") * 1000).alias("n_bytes"))
    return rows.withColumn("accepted", quality.upload(F.concat(F.lit("cv."), "suffix"), F.col("n_bytes")))


@query("select doc_id, octet_length(encode(text))::bigint as n_bytes, md5(text) as digest from documents")
def uploaded_files(spark, d):
    """Documents written as files of their own and read back as uploads, with suffix and size checked."""
    path = _path(spark, "uploads")
    documents.write_texts(tables.table(spark, d, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("name"), "text"), path)
    found = documents.read_documents(spark, path)
    return found.select(F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long").alias("doc_id"), "n_bytes", F.md5(F.col("raw_text").cast("binary")).alias("digest"))


@query("with s as (select distinct size as n from (select 5 + o_orderkey % 21 as size from orders)) select n, category, quota::bigint as quota from s, lateral (values " + ", ".join(f"('{c}', floor(n * {s}) + case when '{c}' = 'project' and floor(n * {s}) = 0 then 1 else 0 end)" for c, s in questions.SHARES.items()) + ") t(category, quota)")
def question_quota(spark, d):
    """Quotas of each plan size that the interviews ask for."""
    return questions.quotas_of(tables.table(spark, d, "orders").select((F.lit(5) + F.col("o_orderkey") % 21).alias("n")))
