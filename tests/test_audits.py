"""Audits: digests that order counts in, windows across chunks, interval arithmetic against minutes counted one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits


def digest(spark, rows, size):
    df = spark.createDataFrame(rows, "seq long, body string").repartition(3)
    return tuple(audits.ordered_digest(df, "seq", F.col("body"), size).collect()[0])


@pytest.mark.parametrize("size", [4, 4096])
def test_digest_sees_order_and_loss(spark, size):
    rows = [(i, f"b{i % 7}") for i in range(60)]
    whole = digest(spark, rows, size)
    assert whole[:5] == (60, 0, 59, 0, 0) and digest(spark, rows[::-1], size) == whole
    swapped = [(i, {10: "b4", 11: "b3"}.get(i, b)) for i, b in rows]
    assert digest(spark, swapped, size)[5] != whole[5]
    lost = [r for r in rows if r[0] not in (7, 8, 20, 31, 32)]
    assert digest(spark, lost, size)[:5] == (55, 0, 59, 5, 3) and digest(spark, lost, size)[5] != whole[5]
    assert digest(spark, rows[5:], size)[:5] == (55, 5, 59, 0, 0)


def test_since_last_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(audits, "CHUNK", 5)
    r = random.Random(1)
    rows = [(i, r.choice("abc"), r.randint(0, 99)) for i in range(100) if r.random() < 0.8]
    want, last = {}, {}
    for i, k, at in rows:
        want[i], last[k] = last.get(k), at
    got = audits.since_last(spark.createDataFrame(rows, "seq long, kind string, at long").repartition(3)).collect()
    assert {x["seq"]: x["before"] for x in got} == want


def test_nearest_ranks(spark):
    rows = [("a", v) for v in range(1, 101)] + [("b", 5), ("b", None), ("c", None)]
    got = {r[0]: tuple(r)[1:] for r in audits.nearest_ranks(spark.createDataFrame(rows, "k string, v long"), "k", "v", {"p50": 0.5, "p99": 0.99, "all": 1.0}).collect()}
    assert got == {"a": (50, 99, 100), "b": (5, 5, 5)}


def test_uncovered_equals_minutes(spark):
    r = random.Random(2)
    make = lambda n: [(k, a, a + r.randint(-2, 12)) for k in "xy" for a in [r.randint(0, 90) for _ in range(n)]]
    wanted, covering = make(6), make(5)
    schema = "k string, start long, end long"
    got = audits.uncovered(spark.createDataFrame(wanted, schema), spark.createDataFrame(covering, schema), ["k"]).collect()
    minutes = lambda rows, k: {m for kk, a, b in rows if kk == k for m in range(a, b)}
    for k in "xy":
        own = [(x["k"], x["start"], x["end"]) for x in got if x["k"] == k]
        assert minutes(own, k) == minutes(wanted, k) - minutes(covering, k)
        assert all(b < c for (_, _, b), (_, c, _) in zip(sorted(own), sorted(own)[1:], strict=False))
    assert audits.uncovered(spark.createDataFrame([], schema), spark.createDataFrame(covering, schema), ["k"]).count() == 0


def test_turnover_counts_members_by_equality(spark):
    from tidemark.operators import market

    members = spark.createDataFrame([("t", i, s) for i, s in enumerate([3, 3, 5, 9, 40])] + [("u", 7, 0)], "theme_id string, stock_id int, since long")
    slots = spark.createDataFrame([(b, d) for b in (0, 1) for d in (2, 4, 5, 9, 10) if (b, d) != (1, 9)], "bucket int, day_number long")
    counted = market.known_members(members, slots)
    got = {(r["theme_id"], r["bucket"], r["day_number"]): r["total"] for r in counted.collect()}
    own = {"t": [3, 3, 5, 9, 40], "u": [0]}
    want = {(t, b, d): n for t, s in own.items() for b in (0, 1) for d in (2, 4, 5, 9, 10) if (b, d) != (1, 9) and (n := sum(x <= d for x in s))}
    assert got == want and "NestedLoop" not in counted._jdf.queryExecution().executedPlan().toString()


def test_unknown_flags_give_no_return(spark):
    from datetime import date

    from tidemark.operators import market

    good = {"ref_known": date(2024, 1, 1), "ref_resolved": True, "ref_for": date(2024, 1, 2), "ref_close": 10.0, "obs_at": date(2024, 1, 2), "obs_day": date(2024, 1, 2), "obs_halted": False, "obs_unresolved": False, "obs_fresh": True, "obs_price": 11.0}
    schema = "ref_known date, ref_resolved boolean, ref_for date, ref_close double, obs_at date, obs_day date, obs_halted boolean, obs_unresolved boolean, obs_fresh boolean, obs_price double"
    cases = [good, *({**good, k: None} for k in good)]
    day = F.lit("2024-01-02").cast("date")
    got = [r["ret"] for r in market.stock_return(spark.createDataFrame([tuple(c.values()) for c in cases], schema).coalesce(1), day, day).collect()]
    assert got == [pytest.approx(0.1)] + [None] * len(good)
