"""The session entities, as views over the parquet tables (events are violations and gaze samples, documents are resumes, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, interview_id, ts, event_type and confidence of every report."""
    kind = F.when(F.col("event_type") == "view", "looking_away").when(F.col("event_type") == "signup", "tab_switch").when(F.col("event_type") == "error", "no_face").when(F.col("event_type") == "click", "window_blur").otherwise("copy_attempt")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("interview_id"), "ts", kind.alias("event_type"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"))


def gaze_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), "ts", F.col("event_type").isin("error", "click").cast("int").alias("away"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, frame_no and samples of audio frames."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("session"), F.col("vec_id").alias("frame_no"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("completed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("interview_id"), F.col("o_custkey").alias("resume_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("experience_level"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"), F.col("c_name").alias("candidate_name"), F.col("c_mktsegment").alias("segment"))


def voice_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, ts, id, speech and energy of user frames."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("id"), (F.col("value") >= 150).alias("speech"), F.col("value").alias("energy"))


def model_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, ts, id and said of what the model does: an assistant's turn begins its speech, another ends it; turns are three days apart."""
    at = F.timestamp_millis(F.lit(1704067200000) + F.col("turn") * 259_200_000 + F.col("conv_id") * 60_000)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), at.alias("ts"), F.col("turn").alias("id"), (F.col("role") == "assistant").alias("said"))
