"""Voice activity and turns: rolling noise floor, hysteresis, frame-gap sessions, barge-in, playback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import audio


def _frames() -> WindowSpec:
    return Window.partitionBy("session").orderBy("frame_no")


def features(frames: DataFrame) -> DataFrame:
    return frames.select("session", "frame_no", audio.energy(F.col("x")).alias("energy"), audio.peak(F.col("x")).alias("peak"), audio.zero_crossings(F.col("x")).alias("zcr"))


def noise_floor(frames: DataFrame) -> DataFrame:
    """The energy at 30% of the last 150 sorted energies, from 30 frames on; 0.01 before."""
    held = F.sort_array(F.collect_list("energy").over(_frames().rowsBetween(-149, 0)))
    out = frames.withColumn("_held", held).withColumn("_n", F.size("_held"))
    return out.withColumn("floor", F.when(F.col("_n") >= 30, F.get("_held", F.floor(F.col("_n") * 30 / 100).cast("int"))).otherwise(F.lit(0.01))).drop("_held", "_n")


def crossing_floor(frames: DataFrame) -> DataFrame:
    """The zero-crossing rate at a quarter of the last 50 sorted ones, from 20 frames on; null before. No decision uses it."""
    held = F.sort_array(F.collect_list("zcr").over(_frames().rowsBetween(-49, 0)))
    out = frames.withColumn("_held", held).withColumn("_n", F.size("_held"))
    return out.withColumn("zcr_floor", F.when(F.col("_n") >= 20, F.get("_held", F.floor(F.col("_n") / 4).cast("int")))).drop("_held", "_n")


def speech_votes(frames: DataFrame) -> DataFrame:
    """Two of: energy over the floor, zero crossings and centroid in their ranges."""
    votes = (F.col("energy") > F.greatest(F.lit(0.025), 3 * F.col("floor"))).cast("int") + ((F.col("zcr") > 0.15) & (F.col("zcr") < 0.5)).cast("int") + ((F.col("centroid") > 0.15) & (F.col("centroid") < 0.7)).cast("int")
    return frames.withColumn("speech", (votes >= 2).cast("int"))


def latch(frames: DataFrame, on: int = 5, off: int = 12) -> DataFrame:
    """Speaking after `on` speech frames in a row, until `off` silent ones."""
    a, b = _frames().rowsBetween(-(on - 1), 0), _frames().rowsBetween(-(off - 1), 0)
    change = F.when(F.sum("speech").over(a) == on, True).when((F.count(F.lit(1)).over(b) == off) & (F.sum("speech").over(b) == 0), False)
    out = frames.withColumn("_change", change)
    return out.withColumn("speaking", F.coalesce(F.last("_change", ignorenulls=True).over(_frames().rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))).drop("_change")


def _voice(features: DataFrame, frames: DataFrame) -> DataFrame:
    """Floor, vote and latch over the features of frames that aren't empty; an empty or null frame is no speech and leaves the others' floor and latch alone."""
    out = latch(speech_votes(noise_floor(features)))
    empty = frames.where(~F.coalesce(F.size("x") > 0, F.lit(False))).select("session", "frame_no", F.lit(0).alias("speech"), F.lit(False).alias("speaking"))
    return out.unionByName(empty, allowMissingColumns=True)


def voice_activity(frames: DataFrame) -> DataFrame:
    """Features, floor, vote and latch of every frame (gain first, as energy is measured after it).

    A session is one ordered partition: give long recordings session keys of their own, or take scan.latch.
    """
    found = frames.where(F.size("x") > 0).select("session", "frame_no", audio.voice_features("x", F.lit(None).cast("array<double>")).alias("f"))
    return _voice(found.select("session", "frame_no", "f.*"), frames)


def voice_pipeline(frames: DataFrame) -> DataFrame:
    """voice_activity of denoised frames: one Arrow step makes the features of each frame, and only these go through the windows."""
    found = audio.with_noise(frames.where(F.size("x") > 0)).select("session", "frame_no", audio.voice_features("x", "noise").alias("f"))
    return _voice(found.select("session", "frame_no", "f.*"), frames)


def turns(speech: DataFrame, gap: int = 30) -> DataFrame:
    """turn of every speech frame (session, frame_no): a new one after more than gap frames without."""
    new = F.coalesce(F.col("frame_no") - F.lag("frame_no").over(_frames()) > gap, F.lit(True))
    return speech.withColumn("_new", new.cast("int")).withColumn("turn", F.sum("_new").over(_frames())).drop("_new")


def turn_spans(frames: DataFrame, gap: int = 30) -> DataFrame:
    """First and last speech frame and size of each turn of frames (session, frame_no, speech). A turn is complete at the frame gap after its last one; null where the session ends before."""
    spans = turns(frames.where("speech").select("session", "frame_no"), gap).groupBy("session", "turn").agg(F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"), F.count(F.lit(1)).alias("n_frames"))
    ends = frames.groupBy(F.col("session").alias("_session")).agg(F.max("frame_no").alias("_end"))
    done = F.col("last_frame") + gap
    return spans.join(ends, F.col("session").eqNullSafe(F.col("_session"))).withColumn("complete_frame", F.when(done <= F.col("_end"), done)).drop("_session", "_end")


def barge_ins(frames: DataFrame, gap: int = 30) -> DataFrame:
    """Turn starts with the other side's state just before (frames: session, frame_no, speech, said: true, false or null)."""
    state = F.coalesce(F.last("said", ignorenulls=True).over(_frames().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    marked = frames.withColumn("speaking", state).where("speech")
    new = F.coalesce(F.col("frame_no") - F.lag("frame_no").over(_frames()) > gap, F.lit(True))
    return marked.withColumn("starts", new).where("starts").select("session", "frame_no", F.col("speaking").alias("barge_in"))


def playback(chunks: DataFrame) -> DataFrame:
    """start = max(arrival, end of the one before) for chunks (session, seq, arrival, duration), as a running maximum."""
    w = Window.partitionBy("session").orderBy("seq")
    out = chunks.withColumn("_before", F.sum("duration").over(w) - F.col("duration"))
    return out.withColumn("start", F.col("_before") + F.max(F.col("arrival") - F.col("_before")).over(w)).drop("_before")
