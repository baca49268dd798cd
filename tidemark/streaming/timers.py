"""State with event-time timers: holds, closes and times to live that come due without a further input.

Each stream operator has a batch twin that folds the same step over the table, so that the two can be compared: before an input is taken,
whatever has come due by its time is; at the end, whatever has come due by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from . import keyed

#: A closed event's state is kept so long (its late inputs are TERMINAL), then dropped.
FORGET_S = 3600.0
#: The configuration that stateful processors need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HELD = {"CANDIDATE": ("good", keyed.ACTIVATE_S, True), "ACTIVE": ("below", keyed.WEAKEN_S, False), "WEAKENING": ("weak_below", keyed.CLOSE_S, False)}
_MOVES = "key long, at double, input_id long, disposition string, state string"
_FIELDS = StructType([StructField(n, t()) for n, t in (("state", StringType), ("good", DoubleType), ("below", DoubleType), ("weak", DoubleType), ("weak_below", DoubleType), ("sequence", LongType), ("at", DoubleType), ("id", LongType))])


def due_at(s: dict) -> float | None:
    """When the state moves by itself: the end of the hold that runs, or the time to forget a closed event."""
    if s["state"] not in HELD:
        return s["at"] + FORGET_S
    name, seconds, _ = HELD[s["state"]]
    return None if s[name] is None else s[name] + seconds


def come_due(s: dict, now: float) -> list[tuple]:
    """Applies the moves that come due by now, in order; rows of (at, input_id, disposition, state). A forgotten state is CLOSED with id and sequence gone."""
    out = []
    while (at := due_at(s)) is not None and at <= now:
        if s["state"] not in HELD:
            s.update(keyed.hysteresis_start())
            out.append((at, None, "FORGOTTEN", None))
            continue
        i, sequence, last = s["id"], s["sequence"], s["at"]
        _, state = keyed.hysteresis_step(s, (-1, (sequence if sequence is not None else 0) + 1, at, HELD[s["state"]][2], False, False))
        s.update(id=i, sequence=sequence, at=max(last, at))  # a timer is no input: numbers go on from the last one
        out.append((at, None, "TIMER", state))
    return out


def take(s: dict, row: tuple) -> list[tuple]:
    """One input (input_id, sequence, at, qualifies, market_closed, expired) after what is due by its time."""
    out = come_due(s, row[2])
    disposition, state = keyed.hysteresis_step(s, row)
    return [*out, (row[2], row[0], disposition, state)]


_INPUTS = ("input_id", "sequence", "at", "qualifies", "market_closed", "expired")


def hysteresis_with_timers(signals: DataFrame, until: float) -> DataFrame:
    """signals: key (long), input_id, sequence, at (seconds), qualifies, market_closed, expired. Every input's disposition and every move by time up to
    `until`. Keys are dealt out and sorted by Spark; a task holds one small state."""
    shape = pa.schema([("key", pa.int64()), ("at", pa.float64()), ("input_id", pa.int64()), ("disposition", pa.string()), ("state", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, s = None, None
        out: list[tuple] = []
        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", *_INPUTS)), strict=True):
                if k != key or s is None:
                    out.extend((key, *r) for r in (come_due(s, until) if s else ()))
                    key, s = k, keyed.hysteresis_start()
                out.extend((k, *r) for r in take(s, tuple(row)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)
                out = []
        out = [(key, *r) for r in (come_due(s, until) if s else ())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    return signals.select("key", *_INPUTS).repartition("key").sortWithinPartitions("key", "at", "sequence").mapInArrow(run, _MOVES)


def _plain(rows: Iterator[pd.DataFrame], columns: tuple) -> list[tuple]:
    frames = [f for f in rows if len(f)]
    if not frames:
        return []
    whole = pd.concat(frames)
    return list(zip(*(whole[c].astype(object).where(whole[c].notna(), None) for c in columns), strict=True))


class _Hysteresis(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", _FIELDS)

    def _save(self, s: dict) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if s["id"] is None and s["at"] is None:
            self.held.clear()
            return
        self.held.update(tuple(s.values()))
        at = due_at(s)
        if at is not None:
            self.handle.registerTimer(int(at * 1000))

    def _load(self) -> dict:
        return dict(zip(keyed.hysteresis_start(), self.held.get(), strict=True)) if self.held.exists() else keyed.hysteresis_start()

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["key", "at", "input_id", "disposition", "state"]).astype({"input_id": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        for row in sorted(_plain(rows, _INPUTS), key=lambda r: (r[2], r[1])):
            out.extend(take(s, row))
        self._save(s)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        out = come_due(s, expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._save(s)
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def stream_hysteresis_with_timers(signals: DataFrame, late: str) -> DataFrame:
    """The stream's twin: signals as above, with event time `moment` (timestamp of at). Inputs later than `late` behind the newest are dropped; state of closed events is dropped an hour on."""
    watched = signals.withWatermark("moment", late)
    return watched.groupBy("key").transformWithStateInPandas(statefulProcessor=_Hysteresis(), outputStructType=_MOVES, outputMode="Append", timeMode="EventTime")


# candidates with a time to live

_CHANGES = "stock long, at double, change string, conditions long"
_SIGNALS = ("at", "condition", "enters", "event_id")


def candidate_step(s: dict, row: tuple, ttl: float) -> list[tuple]:
    """s: conditions (set) and last (seconds of the last entry). Rows of (at, change, conditions): ENTERED, LEFT or EXPIRED, or none where nothing changed."""
    at, condition, enters, _ = row
    out = candidate_expires(s, at, ttl)
    if enters:
        new = not s["conditions"]
        s["conditions"].add(condition)
        s["last"] = at
        out.append((at, "ENTERED" if new else "KEPT", len(s["conditions"])))
    elif condition in s["conditions"]:
        s["conditions"].discard(condition)
        out.append((at, "KEPT" if s["conditions"] else "LEFT", len(s["conditions"])))
    return out


def candidate_expires(s: dict, now: float, ttl: float) -> list[tuple]:
    """A candidate whose last entry lies more than ttl back goes: it is due a millisecond after."""
    if s["conditions"] and now > s["last"] + ttl:
        s["conditions"].clear()
        return [(s["last"] + ttl + 0.001, "EXPIRED", 0)]
    return []


def candidates(signals: DataFrame, ttl: float, until: float) -> DataFrame:
    """signals: stock (long), condition, at (seconds), enters, event_id. The changes of the candidate set, those by silence too, up to `until`."""
    shape = pa.schema([("stock", pa.int64()), ("at", pa.float64()), ("change", pa.string()), ("conditions", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stock, s, out = None, None, []
        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("stock", *_SIGNALS)), strict=True):
                if k != stock or s is None:
                    out.extend((stock, *r) for r in (candidate_expires(s, until, ttl) if s else ()))
                    stock, s = k, {"conditions": set(), "last": None}
                out.extend((k, *r) for r in candidate_step(s, tuple(row), ttl))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(shape)], schema=shape)
            out = []
        out = [(stock, *r) for r in (candidate_expires(s, until, ttl) if s else ())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(shape)], schema=shape)

    return signals.select("stock", *_SIGNALS).repartition("stock").sortWithinPartitions("stock", "at", "event_id").mapInArrow(run, _CHANGES)


class _Candidates(StatefulProcessor):
    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.met = handle.getMapState("conditions", StructType([StructField("condition", StringType())]), StructType([StructField("on", BooleanType())]))
        self.last = handle.getValueState("last", StructType([StructField("at", DoubleType())]))

    def _load(self) -> dict:
        return {"conditions": {k[0] for k in self.met.keys()} if self.met.exists() else set(), "last": self.last.get()[0] if self.last.exists() else None}

    def _save(self, s: dict) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.met.clear()
        if not s["conditions"]:
            self.last.clear()
            return
        for c in s["conditions"]:
            self.met.updateValue((c,), (True,))
        self.last.update((s["last"],))
        self.handle.registerTimer(int((s["last"] + self.ttl) * 1000) + 1)

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["stock", "at", "change", "conditions"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        for row in sorted(_plain(rows, _SIGNALS), key=lambda r: (r[0], r[3])):
            out.extend(candidate_step(s, row, self.ttl))
        self._save(s)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        out = candidate_expires(s, expiredTimerInfo.getExpiryTimeInMs() / 1000, self.ttl)
        self._save(s)
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def stream_candidates(signals: DataFrame, ttl: float, late: str) -> DataFrame:
    """The stream's twin of candidates(), with event time `moment`; nothing is kept of stocks that left or expired."""
    watched = signals.withWatermark("moment", late)
    return watched.groupBy("stock").transformWithStateInPandas(statefulProcessor=_Candidates(ttl), outputStructType=_CHANGES, outputMode="Append", timeMode="EventTime")
