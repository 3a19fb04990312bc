"""A corpus pipeline: language, near copies, benchmark passages, source weights, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; further columns, whatever their names, are carried along as they
are. Rows without an id or text, empty tables, very long texts and equal rows pass as the operators define. Of rows that
are near copies the one with the least id stays, of those with equal ids the one with the least hash of its text, of those
with equal texts too any one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionspark.llm import decontamination, jaccard, langid, mixing, textio, tokenfile

#: Texts whose best language has a lower mean probability are rejected, as are those without letters.
LEAST_SCORE = 0.4

#: No SQL: the stages train a model and use hashes that DuckDB lacks.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is found."""
    found = langid.identify(docs.select(*textio.apart(docs, "text")), langid.fit(docs), keys=["_rest", "_text"], text="_text")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*textio.whole(docs.columns, "text"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group (links of similarity 0.8 over five-word shingles): that with the least id (then the least text hash)."""
    marked = docs.select(*textio.carried(docs, "doc_id", "text")).withColumn("_hash", F.xxhash64("_c1"))
    groups, path = textio.save(jaccard.group_similar(marked.select("_c0", "_hash", "_c1"), keys=["_c0", "_hash"], text="_c1"), "groups")
    first = groups.groupBy("label").agg(F.min(F.struct(F.col("_c0").isNull().alias("none"), "_c0", "_hash")).alias("k")).select(F.col("k._c0").alias("_kept_id"), F.col("k._hash").alias("_kept_hash"))
    kept = marked.join(first, F.col("_c0").eqNullSafe(F.col("_kept_id")) & (F.col("_hash") == F.col("_kept_hash")), "left_semi")
    if groups.groupBy("_c0", "_hash").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["_c0", "_hash"])
    return kept.select("_doc.*")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a window of words with a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = docs.select(*textio.carried(docs, "doc_id", "text")).withColumn("_hash", F.xxhash64("_c1"))
    found = decontamination.decontaminate(marked.select("_c0", "_hash", "_c1"), items, keys=["_c0", "_hash"], text="_c1")
    hit = found.where("contaminated").select(F.col("_c0").alias("_hit_id"), F.col("_hash").alias("_hit_hash")).distinct()
    return marked.join(hit, F.col("_c0").eqNullSafe(F.col("_hit_id")) & (F.col("_hash") == F.col("_hit_hash")), "left_anti").select("_doc.*")


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, dealt to shards and shuffled in each: a row for each piece of a drawn block, with its words."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token-id file and return what was read back from it."""
    return tokenfile.encode_to_file(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("source_weights", source_weights), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage wrote on its way is deleted once the stage is written."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with textio.scope(spark) as keep:
            docs, path = textio.save(stage(spark, docs, sf_dir), name)
            keep(path)
        textio.drop(spark, *([kept] if kept else []))
        kept = path
    return docs
