"""Ordered per-key folds: what a stateful stream operator does, over a table. Spark deals the keys out and sorts; a task reads each key's rows
in order with one small state in memory, however many rows the key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ACTIVATE_S, WEAKEN_S, RECOVER_S, CLOSE_S = 10.0, 60.0, 600.0, 600.0


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, tuple], tuple], inputs: list[str], schema: str) -> DataFrame:
    """For each row of each key, in order: the columns keys and order, then what step(state, inputs) returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), {}
        for batch in batches:
            out = []
            rows = lambda names: zip(*(batch.column(n).to_pylist() for n in names), strict=True)  # noqa: E731, B023
            for head, place, row in zip(rows(keys), rows(order), rows(inputs), strict=True):
                if head != current:
                    current, state = head, start()
                out.append((*head, *place, *step(state, row)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    shape = to_arrow_schema(StructType.fromDDL(schema))
    chosen = df.select(*dict.fromkeys([*keys, *order, *inputs]))
    return chosen.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def hysteresis_start() -> dict:
    return {"state": "CANDIDATE", "good": None, "below": None, "weak": None, "weak_below": None, "sequence": None, "at": None, "id": None}


def hysteresis_step(s: dict, row: tuple) -> tuple[str, str]:
    """row: input_id, sequence, at (seconds), qualifies (null: cannot tell), market_closed, expired. Returns disposition and state.

    A repeated, out-of-order or late input changes nothing. The market's close ends the event: DISCARDED if it never was active, else CLOSED. An
    unknown input sets the timer of the present state back; a transition sets back all."""
    i, sequence, at, q, closed, expired = row
    if i == s["id"]:
        return "DUPLICATE", s["state"]
    if s["sequence"] is not None and sequence <= s["sequence"]:
        return "STALE_SEQUENCE", s["state"]
    if s["at"] is not None and at < s["at"]:
        return "STALE_TIME", s["state"]
    s.update(sequence=sequence, at=at, id=i)
    if s["state"] in ("CLOSED", "DISCARDED"):
        return "TERMINAL", s["state"]

    def move(target: str, **timers) -> tuple[str, str]:
        s.update(state=target, good=None, below=None, weak=None, weak_below=None)
        s.update(timers)
        return "TRANSITIONED", target

    if closed:
        return move("DISCARDED" if s["state"] == "CANDIDATE" else "CLOSED")
    if expired and s["state"] == "CANDIDATE":
        return move("DISCARDED")
    timer = {"CANDIDATE": "good", "ACTIVE": "below", "WEAKENING": "weak_below"}[s["state"]]
    runs = q is not None and bool(q) == (s["state"] == "CANDIDATE")
    if q is not None and s["state"] == "WEAKENING" and q:
        return move("ACTIVE" if at - s["weak"] <= RECOVER_S else "CLOSED")
    if not runs:
        s[timer] = None
        return "NO_TRANSITION", s["state"]
    s[timer] = at if s[timer] is None else s[timer]
    lasted = at - s[timer]
    if s["state"] == "CANDIDATE" and lasted >= ACTIVATE_S:
        return move("ACTIVE")
    if s["state"] == "ACTIVE" and lasted >= WEAKEN_S:
        return move("WEAKENING", weak=at, weak_below=at)
    if s["state"] == "WEAKENING" and lasted >= CLOSE_S:
        return move("CLOSED")
    return "NO_TRANSITION", s["state"]


def hysteresis(signals: DataFrame, keys: list[str], key_types: str) -> DataFrame:
    """signals: keys, arrival, input_id, sequence, at, qualifies, market_closed, expired. Disposition and state after each input, in order of arrival."""
    return fold_sorted(signals, keys, ["arrival"], hysteresis_start, hysteresis_step, ["input_id", "sequence", "at", "qualifies", "market_closed", "expired"], f"{key_types}, arrival long, disposition string, state string")


def stream_hysteresis(signals: DataFrame) -> DataFrame:
    """The stream's twin of hysteresis: signals with one column key (long); its state is kept by Spark between micro-batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    fields = "state string, good double, below double, weak double, weak_below double, sequence long, at double, id long"

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(hysteresis_start(), held.get, strict=True)) if held.exists else hysteresis_start()
        rows = pd.concat(list(frames)).sort_values("arrival")
        whole = rows.astype(object).where(rows.notna(), None)
        out = [(key[0], r[0], *hysteresis_step(s, r[1:])) for r in zip(*(whole[c] for c in ("arrival", "input_id", "sequence", "at", "qualifies", "market_closed", "expired")), strict=True)]
        held.update(tuple(None if v is None else type(v)(v) for v in s.values()))
        yield pd.DataFrame(out, columns=["key", "arrival", "disposition", "state"])

    return signals.groupBy("key").applyInPandasWithState(run, "key long, arrival long, disposition string, state string", fields, "append", GroupStateTimeout.NoTimeout)


def fence_start() -> dict:
    return {"session": None, "seen": {}, "cursor": {}, "latest": None}


def fence_step(s: dict, row: tuple) -> tuple[str]:
    """row: session, identity, payload, lane, position, received, occurred, realtime. Dispositions in order: OLD_SESSION, DUPLICATE or CONFLICT (same
    identity, by payload), OUT_OF_ORDER (position or receipt behind the lane's last accepted), OLD_OBSERVATION (an older source time; on equal times a
    snapshot after a realtime value; within a source an older receipt), ACCEPTED. Only accepted events move the state."""
    session, identity, payload, lane, position, received, occurred, realtime = row
    if s["session"] is None or session > s["session"]:
        s.update(session=session, cursor={})
    if session < s["session"]:
        return ("OLD_SESSION",)
    if identity in s["seen"]:
        return ("DUPLICATE" if s["seen"][identity] == payload else "CONFLICT",)
    last = s["cursor"].get(lane)
    if last is not None and (position <= last[0] or received < last[1]):
        return ("OUT_OF_ORDER",)
    if s["latest"] is not None:
        then, live, got = s["latest"]
        if occurred < then or occurred == then and (live and not realtime or live == realtime and received < got):
            return ("OLD_OBSERVATION",)
    s["seen"][identity] = payload
    s["cursor"][lane] = (position, received)
    s["latest"] = (occurred, realtime, received)
    return ("ACCEPTED",)


def order_fence(events: DataFrame) -> DataFrame:
    """events: key, arrival and what fence_step takes. Disposition of each event, per key in order of arrival."""
    return fold_sorted(events, ["key"], ["arrival"], fence_start, fence_step, ["session", "identity", "payload", "lane", "position", "received", "occurred", "realtime"], "key long, arrival long, disposition string")


def hot_state(updates: DataFrame) -> DataFrame:
    """updates: day, stock_id, arrival, message_id, source, sequence, received, occurred. Adds disposition and version (of the state after it).

    Windows alone: a message seen before is a DUPLICATE; a sequence not above those of its source before is a STALE_SOURCE_SEQUENCE; a receipt before the
    source's cursor a STALE_RECEIVED_AT; of the others, what is not above the greatest (occurred, received, source, sequence, message_id) so far is a
    STALE_OBSERVATION, and the rest is APPLIED."""
    stock, source = ["day", "stock_id"], ["day", "stock_id", "source"]
    before = lambda keys: Window.partitionBy(*keys).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    u = updates.withColumn("again", F.row_number().over(Window.partitionBy(*stock, "message_id").orderBy("arrival")) > 1)
    u = u.withColumn("cursor", F.max(F.when(~F.col("again"), F.col("sequence"))).over(before(source)))
    u = u.withColumn("ahead", ~F.col("again") & (F.col("cursor").isNull() | (F.col("sequence") > F.col("cursor"))))
    u = u.withColumn("receipt", F.max(F.when(F.col("ahead"), F.col("received"))).over(before(source)))
    u = u.withColumn("behind", F.col("ahead") & F.coalesce(F.col("received") < F.col("receipt"), F.lit(False))).withColumn("fresh", F.col("ahead") & ~F.col("behind"))
    order = F.struct("occurred", "received", "source", "sequence", "message_id")
    u = u.withColumn("top", F.max(F.when(F.col("fresh"), order)).over(before(stock)))
    disposition = F.when(F.col("again"), "DUPLICATE").when(~F.col("ahead"), "STALE_SOURCE_SEQUENCE").when(F.col("behind"), "STALE_RECEIVED_AT").when(F.col("top").isNotNull() & (order <= F.col("top")), "STALE_OBSERVATION").otherwise("APPLIED")
    u = u.withColumn("disposition", disposition)
    return u.withColumn("version", F.count_if(F.col("disposition") == "APPLIED").over(Window.partitionBy(*stock).orderBy("arrival"))).drop("again", "cursor", "ahead", "receipt", "behind", "fresh", "top")
