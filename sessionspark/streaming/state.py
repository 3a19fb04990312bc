"""Keyed state over streams: strikes with a limit, a debounce with greedy reset, an hourly rate limit, voice activity, turns.

Each rule is a small step on (state, rows in order). A batch runs it over sorted partitions; a stream keeps the state in
Spark's store, one value for each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import audio
from ..sources.tables import THRESHOLD

STRIKES = "event_id long, interview_id long, strike_number long, terminates boolean"
EMITTED = "event_id long, session long, event_type string"
ALLOWED = "event_id long, client long, allowed boolean"
TURNS = "session long, frame_no long, turn long, event string"
VOICE = "session int, frame_no long, energy double, zcr double, centroid double, floor double, speech int, speaking boolean"
DEBOUNCE_STATE, RATE_STATE = "last long", "held array<long>"
TURN_STATE, VOICE_STATE = "last long, turn long, silent int", "noise array<double>, learned int, energies array<double>, spoken int, silent int, speaking boolean"

def strike_step(limit: int) -> Callable:
    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        (n,) = state or (0,)
        out = []
        for r in rows.itertuples(index=False):
            if r.confidence >= THRESHOLD and n < limit:
                n += 1
                out.append((r.event_id, r.interview_id, n, n == limit))
        return (n,), pd.DataFrame(out, columns=["event_id", "interview_id", "strike_number", "terminates"])

    return step


def debounce_step(quiet_ms: int) -> Callable:
    """Emit no_face at a sample without a face more than quiet_ms after the last one with a face or the last such emit, and multiple_faces at each sample with several, which resets nothing."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        last = state[0] if state else None
        out = []
        for r in rows.itertuples(index=False):
            now = r.ts.value // 1_000_000
            if last is None or r.faces == 1:
                last = now
            if r.faces > 1:
                out.append((r.event_id, r.session, "multiple_faces"))
            elif r.faces == 0 and now - last > quiet_ms:
                out.append((r.event_id, r.session, "no_face"))
                last = now
        return (last,), pd.DataFrame(out, columns=["event_id", "session", "event_type"])

    return step


def rate_step(limits: dict[str, int], window_ms: int) -> Callable:
    """Allow a request if fewer than its kind's limit were allowed in the window before it; all kinds of a client share one history, and refused ones don't count."""
    most = max(limits.values())

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        held = list(state[0]) if state else []
        out = []
        for r in rows.itertuples(index=False):
            now = r.ts.value // 1_000_000
            held = [t for t in held[-most:] if t > now - window_ms]
            ok = len(held) < limits[r.kind]
            if ok:
                held.append(now)
            out.append((r.event_id, r.client, ok))
        return (held,), pd.DataFrame(out, columns=["event_id", "client", "allowed"])

    return step


def turn_step(gap: int = 30) -> Callable:
    """The turn of every speech frame and what it is: `start` after at least gap frames without speech, `speech` else; and `complete` at the frame with which a turn has had gap silent ones."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        last, turn, silent = state or (None, 0, 0)
        out = []
        for session, frame, speech in zip(rows["session"], rows["frame_no"], rows["speech"].astype(bool), strict=True):
            if speech:
                new = last is None or frame - last > gap
                turn, last, silent = turn + new, frame, 0
                out.append((session, frame, turn, "start" if new else "speech"))
            elif last is not None:
                silent += 1
                if silent == gap:
                    out.append((session, frame, turn, "complete"))
        return (last, turn, silent), pd.DataFrame(out, columns=["session", "frame_no", "turn", "event"])

    return step


def voice_step(on: int = 5, off: int = 12) -> Callable:
    """Noise suppression, gain, features, vote and latch of audio frames (session, frame_no, x), as turns.voice_activity(audio.denoise(frames)) has them."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        noise, learned, energies, spoken, silent, speaking = state or (None, 0, [], 0, 0, False)
        energies, out = list(energies), []
        for r in rows.itertuples(index=False):
            x = np.zeros(0) if r.x is None else np.asarray(r.x, float)
            if not len(x):
                out.append((r.session, r.frame_no, None, None, None, None, 0, False))
                continue
            m = np.abs(np.fft.rfft(x))
            if len(x) > 1 and (noise is None or len(noise) == len(m)):
                if learned < audio.NOISE_FRAMES:
                    noise, learned = m if noise is None else 0.95 * np.asarray(noise) + 0.05 * m, learned + 1
                x = audio.suppressed(x[None], np.asarray(noise)[None])[0]
            top = np.abs(x).max()
            if top > 0.001:
                x = np.clip(x * np.clip(0.7 / top, 0.5, 3.0), -1, 1)
            energy = float(np.sqrt(np.mean(x * x)))
            zcr = float(np.abs(np.diff(np.sign(x))).sum() / (2 * len(x)))
            centroid = float(audio.centroids(x[None])[0])
            energies = [*energies[-149:], energy]
            floor = sorted(energies)[len(energies) * 30 // 100] if len(energies) >= 30 else 0.01
            speech = (energy > max(0.025, 3 * floor)) + (0.15 < zcr < 0.5) + (0.15 < centroid < 0.7) >= 2
            spoken, silent = (spoken + 1, 0) if speech else (0, silent + 1)
            speaking = True if spoken >= on else False if silent >= off else speaking
            out.append((r.session, r.frame_no, energy, zcr, centroid, floor, int(speech), speaking))
        held = None if noise is None else [float(v) for v in noise]
        return (held, learned, energies, spoken, silent, speaking), pd.DataFrame(out, columns=[c.split()[0] for c in VOICE.split(", ")])

    return step


def run_batch(rows: DataFrame, key: str, step: Callable, schema: str, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The rule over a table: rows are dealt by key and sorted, and state passes from batch to batch, so no group is held whole.

    Rows without a key belong to no one: they give nothing.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now = (), None
        for f in frames:
            for k, part in f.groupby(key, sort=False):
                if k != now:
                    state, now = (), k
                state, out = step(state, part)
                yield out

    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def run_stream(rows: DataFrame, key: str, step: Callable, schema: str, state_schema: str, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The rule over a stream; order is that inside a micro-batch. Rows without a key give nothing."""

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ()
        rows_ = pd.concat(list(frames)).sort_values(list(order))
        held, out = step(held, rows_)
        state.update(held)
        yield out

    return rows.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, kind: str) -> DataFrame:
    """Counts and sums in tumbling (1 day), sliding (1 day by 12 hours) or session (2 hours) windows of each event type; events.ts must be a timestamp."""
    w = {"tumbling": F.window("ts", "1 day"), "sliding": F.window("ts", "1 day", "12 hours"), "session": F.session_window("ts", "2 hours")}[kind]
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.round("total", 2).alias("total"))


def disconnects(rows: DataFrame, idle: str, ends: str = "end_interview") -> DataFrame:
    """Stretches of messages (session, ts, event_id, type) that fall silent for idle without an end message: such a session is ended.

    Table and stream alike; a stream needs a watermark on ts, which tells when a stretch is over.
    """
    last = F.max(F.struct("ts", "event_id", "type"))["type"]
    found = rows.groupBy("session", F.session_window("ts", idle).alias("w")).agg(F.count(F.lit(1)).alias("messages"), last.alias("last_type"))
    return found.where(~F.coalesce(F.col("last_type") == ends, F.lit(False))).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("ended_at"), "messages", "last_type")
