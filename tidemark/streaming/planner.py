"""Subscriptions planned from successive demands: a reconciling fold with cooling down, a hard limit and a supplement for what doesn't fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import fold_sorted


@dataclass(frozen=True)
class Limits:
    """Subscriptions wanted at most, and with cooling ones; seconds that an unwanted one is kept; seconds in which changes are taken together."""

    target: int = 180
    hard: int = 200
    cooldown: float = 60.0
    together: float = 1.0


def planner_start() -> dict:
    return {"current": [], "until": {}, "known": {}, "applied": None}


def planner_step(s: dict, row: tuple, limits: Limits) -> tuple:
    """row: at (seconds), demands (rows of stock, priority, signals, observed). Returns subscriptions, added, removed, cooling, supplement, coalesced.

    Rank: smaller priority, more signals, later observation, smaller stock. The first `target` are wanted. A subscription that is wanted no more cools down and stays, ranked by
    its last demand, while there is room below `hard`; the order of those that stay is kept. Within `together` seconds of a change nothing changes."""
    at, demands = row
    now = {d["stock"]: (d["priority"], -d["signals"], -d["observed"], d["stock"]) for d in demands or ()}
    ranked = sorted(now, key=now.__getitem__)
    if s["applied"] is not None and at - s["applied"] < limits.together:
        return s["current"], [], [], [k for k in s["current"] if k in s["until"]], [k for k in ranked if k not in s["current"]], True
    wanted = ranked[: limits.target]
    keep = set(wanted)
    over = {k for k, until in s["until"].items() if k not in keep and until <= at}
    until = {k: u for k, u in s["until"].items() if k not in keep and k not in over}
    until |= {k: at + limits.cooldown for k in s["current"] if k not in keep and k not in until and k not in over}
    rank = s["known"] | now
    cooling = sorted((k for k in s["current"] if k not in keep and until.get(k, at) > at), key=rank.__getitem__)[: limits.hard - len(wanted)]
    stays = keep | set(cooling)
    after = [k for k in s["current"] if k in stays]
    after += [k for k in wanted if k not in set(after)]
    removed = sorted(set(s["current"]) - stays)
    added = sorted(set(after) - set(s["current"]))
    s.update(current=after, until={k: u for k, u in until.items() if k in stays}, known={k: v for k, v in rank.items() if k in stays}, applied=at)
    return after, added, removed, [k for k in after if k in set(cooling)], [k for k in ranked if k not in stays], False


def plans(demands: DataFrame, limits: Limits) -> DataFrame:
    """demands: key (long), at (seconds), stock (long), priority, signals, observed (seconds). One row a key and time of evaluation, in order.

    Demands of a stock at one time are added up first (least priority, sum of signals, last observation). Keys are dealt out; a task holds `hard` subscriptions."""
    one = demands.groupBy("key", "at", "stock").agg(F.min("priority").cast("long").alias("priority"), F.sum("signals").cast("long").alias("signals"), F.max("observed").cast("double").alias("observed"))
    rows = one.groupBy("key", "at").agg(F.collect_list(F.struct("stock", "priority", "signals", "observed")).alias("demands"))
    ids = "array<long>"
    return fold_sorted(rows, ["key"], ["at"], planner_start, lambda s, r: planner_step(s, r, limits), ["at", "demands"], f"key long, at double, subscriptions {ids}, added {ids}, removed {ids}, cooling {ids}, supplement {ids}, coalesced boolean")
