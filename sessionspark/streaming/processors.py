"""Sessions in event time: rows of several inputs are held until the watermark has passed them, put in order, and given to a rule
with named state and deadlines.

A rule (SessionRule below) says what a row does and when something is due if no row comes. Over a stream, InEventTime runs it as a
state processor: rows wait in a map state by time, an event-time timer at each row's time and at each deadline wakes the session,
and the rule's own values are value and list states. Over a table, run_table runs the same rule over sorted partitions. Both
give the same rows, however late or interleaved the rows of a stream come within its watermark; a row behind the watermark is
dropped, as Spark's own aggregates do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Columns of the rows that rules take: user frames (source 0) and model events (source 1) of one session.
ROWS = "session long, ts timestamp, source int, id long, speech boolean, energy double, said boolean"
EVENTS = "session long, at timestamp, kind string, turn long, frames long, barge_in boolean, floor double"
_WAITING = "id long, speech boolean, energy double, said boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionRule:
    """Turns, barge-in, echo gate and silence of a session whose frames and model events come in the order of time.

    A turn begins with a speech frame when none is open, is marked as barge-in if the model is speaking, and is complete `quiet`
    ms after its last speech frame. A session ends `idle` ms after its last row, with its frames, the speech frames that pass the
    echo gate, and the noise floor of its last `kept` energies. quiet is less than idle. Model events at a frame's very time
    count after it.
    """

    #: Named values, and their types.
    VALUES = {"session": "first long, last long, frames long, passed long, speaking boolean", "turn": "turn long, open boolean, last long, frames long"}

    def __init__(self, quiet: int, idle: int, kept: int = 150, percent: int = 30) -> None:
        self.quiet, self.idle, self.kept, self.percent = quiet, idle, kept, percent

    def deadline(self, s: dict) -> int | None:
        """When the session wakes if no row comes."""
        if s["session"] is None:
            return None
        end = s["session"][1] + self.idle
        return min(end, s["turn"][2] + self.quiet) if s["turn"] and s["turn"][1] else end

    def due(self, s: dict, at: int) -> tuple:
        """What a deadline gives; the state goes on without it."""
        turn = s["turn"]
        if turn and turn[1] and turn[2] + self.quiet == at:
            s["turn"] = (turn[0], False, turn[2], 0)
            return (at, "turn_complete", turn[0], turn[3], None, None)
        _, _, frames, passed, _ = s["session"]
        energies = sorted(s["energies"])
        floor = energies[len(energies) * self.percent // 100] if energies else None
        s["session"], s["turn"], s["energies"] = None, None, []
        return (at, "session_ended", passed, frames, None, floor)

    def row(self, s: dict, at: int, source: int, speech: bool | None, energy: float | None, said: bool | None) -> tuple | None:
        first, _, frames, passed, speaking = s["session"] or (at, at, 0, 0, False)
        out = None
        if source == 0:
            frames += 1
            if energy is not None:
                s["energies"] = [*s["energies"][-(self.kept - 1) :], energy]
            if speech:
                passed += not speaking
                turn, open_, _, n = s["turn"] or (0, False, 0, 0)
                if not open_:
                    turn, n = turn + 1, 0
                    out = (at, "turn_started", turn, None, speaking, None)
                s["turn"] = (turn, True, at, n + 1)
        elif said is not None:
            speaking = said
        s["session"] = (first, at, frames, passed, speaking)
        return out

    def upto(self, s: dict, at: int) -> Iterator[tuple]:
        """All deadlines up to a time, in order."""
        while (d := self.deadline(s)) is not None and d <= at:
            yield self.due(s, d)


def _frame(found: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=[c.split()[0] for c in EVENTS.split(", ")])
    out["at"] = pd.to_datetime(out["at"], unit="ms")
    return out.astype({"session": "int64", "turn": "Int64", "frames": "Int64", "barge_in": "boolean", "floor": "float64", "kind": "object"})


class InEventTime(StatefulProcessor):
    """A rule over a stream. Rows wait in the map state `waiting` until the watermark is past them."""

    def __init__(self, rule: SessionRule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, source int, n long", _WAITING)
        self.values = {name: handle.getValueState(name, kind) for name, kind in self.rule.VALUES.items()}
        self.energies = handle.getListState("energies", "energy double")
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, first = timerValues.getCurrentWatermarkInMs(), None
        for f in rows:
            for ts, source, n, speech, energy, said in zip(*(f[c] for c in ("ts", "source", "id", "speech", "energy", "said")), strict=True):
                at = ts.value // 1_000_000
                if at > mark:
                    self.waiting.updateValue((at, int(source), int(n)), (int(n), *(None if pd.isna(v) else v for v in (speech, energy, said))))
                    first = at if first is None else min(first, at)
        self._wake(first)
        return iter(())

    def _wake(self, at: int | None) -> None:
        """One timer for each session, at the earliest time that it has something to do."""
        now = self.alarm.get()[0] if self.alarm.exists() else None
        if at is not None and (now is None or at < now):
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.alarm.clear()
        s = {name: tuple(v.get()) if v.exists() else None for name, v in self.values.items()}
        s["energies"] = [e[0] for e in self.energies.get()] if self.energies.exists() else []
        ready, later = [], None
        for k, v in self.waiting.iterator():
            if k[0] <= mark:
                ready.append((tuple(k), tuple(v)))
            else:
                later = k[0] if later is None else min(later, k[0])
        found = []
        for k, (_, speech, energy, said) in sorted(ready, key=lambda x: x[0]):
            self.waiting.removeKey(k)
            found += self.rule.upto(s, k[0] - 1)
            if (out := self.rule.row(s, k[0], k[1], speech, energy, said)) is not None:
                found.append(out)
        found += self.rule.upto(s, mark)
        for name, v in self.values.items():
            v.clear() if s[name] is None else v.update(s[name])
        self.energies.put([(e,) for e in s["energies"]]) if s["energies"] else self.energies.clear()
        due = self.rule.deadline(s)
        self._wake(min((t for t in (due, later) if t is not None), default=None))
        if found:
            yield _frame([(key[0], *r) for r in found])

    def close(self) -> None:
        pass


def both(frames: DataFrame, model: DataFrame) -> DataFrame:
    """Frames (session, ts, id, speech, energy) and model events (session, ts, id, said) as the rows of one input, times in whole ms; rows without session or time belong nowhere."""
    none = lambda kind: F.lit(None).cast(kind)
    ts = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts")
    a = frames.select("session", ts, F.lit(0).alias("source"), "id", "speech", "energy", none("boolean").alias("said"))
    b = model.select("session", ts, F.lit(1).alias("source"), "id", none("boolean").alias("speech"), none("double").alias("energy"), "said")
    return a.unionByName(b).where("session is not null and ts is not null")


def run_stream(frames: DataFrame, model: DataFrame, rule: SessionRule, delay: str) -> DataFrame:
    """EVENTS of two streams, whose rows come at most delay late. The session needs PROVIDER as its state store."""
    rows = both(frames, model).withWatermark("ts", delay)
    return rows.groupBy("session").transformWithStateInPandas(InEventTime(rule), EVENTS, "append", "eventTime")


def run_table(frames: DataFrame, model: DataFrame, rule: SessionRule, clock: DataFrame | None = None) -> DataFrame:
    """EVENTS of two tables: rows are dealt by session and sorted, and a session's state passes from batch to batch.

    Deadlines count up to the clock: one row with a time, or the latest time of both tables.
    """
    rows = both(frames, model)
    clock = rows.agg(F.max("ts")) if clock is None else clock
    end = clock.first()[0]  # one value
    end = None if end is None else clock.select(F.unix_millis(F.col(clock.columns[0]))).first()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s, columns = None, None, ("session", "ts", "source", "speech", "energy", "said")
        for f in batches:
            found = []
            f["ts"] = f["ts"].astype("datetime64[ms]").astype("int64")
            rows = f[list(columns)].astype(object).where(f[list(columns)].notna(), None)
            for session, at, source, speech, energy, said in rows.itertuples(index=False):
                if s is None or session != now:
                    found += [(now, *r) for r in rule.upto(s, end)] if s is not None else []
                    now, s = session, {**dict.fromkeys(rule.VALUES), "energies": []}
                found += [(session, *r) for r in rule.upto(s, at - 1)]
                if (out := rule.row(s, at, source, speech, energy, said)) is not None:
                    found.append((session, *out))
            yield _frame(found)
        if s is not None:
            yield _frame([(now, *r) for r in rule.upto(s, end)])

    order = ["session", "ts", "source", "id"]
    return rows.repartition("session").sortWithinPartitions(*order).mapInPandas(run, EVENTS)
