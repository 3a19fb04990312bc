"""Features of audio frames (array<double>), in the JVM but for the Fourier transforms."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frames of a session that its noise spectrum is learned from.
NOISE_FRAMES = 50


def energy(x: Column) -> Column:
    """Root of the mean square; 0 of an empty frame."""
    return F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x)))


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0))


def zero_crossings(x: Column) -> Column:
    """Sum of the signs' changes over twice the frame's size."""
    n = F.size(x)
    steps = F.zip_with(F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1), lambda a, b: F.abs(F.signum(b) - F.signum(a)))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v) / (2.0 * n))


def gain(x: Column) -> Column:
    p = peak(x)
    return F.when(p > 0.001, F.greatest(F.lit(0.5), F.least(F.lit(3.0), 0.7 / p))).otherwise(F.lit(1.0))


def once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(value) with the value computed once for a row, however often a lambda inside the rule reads it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def gained(x: Column) -> Column:
    return once(gain(x), lambda g: F.transform(x, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * g))))


def pcm16(x: Column) -> Column:
    """Samples times 32767, cut to whole numbers."""
    return F.transform(x, lambda v: F.when(v < 0, F.ceil(v * 32767)).otherwise(F.floor(v * 32767)).cast("int"))


def from_pcm16(x: Column) -> Column:
    return F.transform(x, lambda v: v / 32768.0)


def pcm16_limited(x: Column) -> Column:
    """pcm16 of samples that are first divided by their peak, if it is over 1."""
    return pcm16(once(peak(x), lambda p: F.transform(x, lambda v: F.when(p > 1, v / p).otherwise(v))))


def _by_length(frames: pd.Series, rule) -> list:
    """rule(2-d array) of the frames of each length at once; None for null frames."""
    out, where = [None] * len(frames), {}
    for k, x in enumerate(frames):
        if x is not None:
            where.setdefault(len(x), []).append(k)
    for at in where.values():
        for k, value in zip(at, rule(np.array([frames.iloc[k] for k in at], float)), strict=True):
            out[k] = value
    return out


def centroids(frames: np.ndarray) -> np.ndarray:
    """Mean bin of the magnitudes over the number of bins, for frames of one length; 0 of empty ones."""
    if not frames.shape[1]:
        return np.zeros(len(frames))
    m = np.abs(np.fft.rfft(frames, axis=1))
    return (m * np.arange(m.shape[1])).sum(axis=1) / (m.sum(axis=1) + 1e-8) / m.shape[1]


@F.pandas_udf(T.DoubleType())
def spectral_centroid(frames: pd.Series) -> pd.Series:
    return pd.Series(_by_length(frames, centroids), dtype=object)


def suppressed(frames: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Frames of one length less 1.5 times their noise spectra, with a tenth of their magnitudes at least. Odd lengths come back one sample short."""
    f = np.fft.rfft(frames, axis=1)
    m = np.abs(f)
    return np.fft.irfft(np.maximum(m - 1.5 * noise, 0.1 * m) * np.exp(1j * np.angle(f)), axis=1)[:, : frames.shape[1]]


def noise_spectra(frames: pd.DataFrame) -> pd.DataFrame:
    """The running noise spectrum after each of a session's first frames (k = 0, 1, ...)."""
    frames = frames.sort_values("k")
    noise, out = None, []
    for x in frames["x"]:
        m = np.abs(np.fft.rfft(np.asarray(x, float)))
        noise = m if noise is None else 0.95 * noise + 0.05 * m
        out.append(noise.tolist())
    return frames[["session", "k"]].assign(noise=out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def subtracted(frames: pd.Series, noise: pd.Series) -> pd.Series:
    """Each frame less its noise; without a noise spectrum as it is."""
    out, where = list(frames), {}
    for k, n in enumerate(noise):
        if n is not None:
            where.setdefault(len(frames.iloc[k]), []).append(k)
    for at in where.values():
        found = suppressed(np.array([frames.iloc[k] for k in at], float), np.array([noise.iloc[k] for k in at], float))
        for k, x in zip(at, found, strict=True):
            out[k] = x
    return pd.Series(out, dtype=object)


def with_noise(frames: DataFrame) -> DataFrame:
    """session, frame_no, x and noise of every frame: the spectrum that is taken from it, null where none is.

    The spectrum is learned from a session's first frames; only those are gathered, and each frame is then joined to the
    spectrum of its place, or to the last one. Frames whose number of bins isn't that of the session's first, and frames of one
    sample, are left as they are and teach nothing; so do empty ones.
    """
    order = Window.partitionBy("session").orderBy(F.asc_nulls_last("frame_no"), "x").rowsBetween(Window.unboundedPreceding, 0)
    numbered = frames.select("session", "frame_no", "x", F.when(F.size("x") > 1, F.floor(F.size("x") / 2).cast("int")).alias("bins"))
    numbered = numbered.withColumn("fits", F.coalesce(F.col("bins") == F.first("bins", ignorenulls=True).over(order), F.lit(False)))
    numbered = numbered.withColumn("k", F.count_if("fits").over(order).cast("int") - 1)
    kinds = frames.schema
    first = numbered.where(F.col("fits") & (F.col("k") < NOISE_FRAMES)).select("session", "k", "x")
    learned = first.groupBy("session").applyInPandas(noise_spectra, T.StructType([kinds["session"], T.StructField("k", T.IntegerType()), T.StructField("noise", T.ArrayType(T.DoubleType()))]))
    learned = learned.select(F.col("session").alias("_session"), F.col("k").alias("_k"), "noise")
    on = F.col("session").eqNullSafe(F.col("_session")) & (F.least("k", F.lit(NOISE_FRAMES - 1)) == F.col("_k"))
    return numbered.join(learned, on, "left").select("session", "frame_no", "x", F.when(F.col("fits"), F.col("noise")).alias("noise"))


def denoise(frames: DataFrame) -> DataFrame:
    """session, frame_no and x of every frame, its noise subtracted (with_noise says which is)."""
    return with_noise(frames).select("session", "frame_no", subtracted("x", "noise").alias("x"))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("energy", "zcr", "centroid")]))
def voice_features(frames: pd.Series, noise: pd.Series) -> pd.DataFrame:
    """Energy, zero crossings and centroid of each frame after suppression and gain, in one step; null of empty and null frames."""
    out = np.full((len(frames), 3), np.nan)
    where: dict[tuple[int, bool], list[int]] = {}
    for k, (x, n) in enumerate(zip(frames, noise, strict=True)):
        if x is not None and len(x):
            where.setdefault((len(x), n is not None), []).append(k)
    for (_, noisy), at in where.items():
        x = np.array([frames.iloc[k] for k in at], float)
        if noisy:
            x = suppressed(x, np.array([noise.iloc[k] for k in at], float))
        top = np.abs(x).max(axis=1)
        g = np.where(top > 0.001, np.clip(0.7 / np.maximum(top, 1e-9), 0.5, 3.0), 1.0)
        x = np.clip(x * g[:, None], -1, 1)
        out[at, 0] = np.sqrt((x * x).mean(axis=1))
        out[at, 1] = np.abs(np.diff(np.sign(x), axis=1)).sum(axis=1) / (2 * x.shape[1])
        out[at, 2] = centroids(x)
    found = pd.DataFrame(out, columns=["energy", "zcr", "centroid"])
    return found.astype(object).where(found.notna(), None)
