"""Golden and metamorphic cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, metrics, timeseries
from tidemark.streaming import folds, keyed


def weights(spark, caps):
    m = spark.createDataFrame([("t", i, "CORE", float(c)) for i, c in enumerate(caps)], "theme_id string, stock_id long, role string, cap double")
    return [r["weight"] for r in metrics.capped_weights(m).orderBy("stock_id").collect()]


def test_capped_weights_golden(spark):
    assert weights(spark, [70, 20, 5, 5]) == pytest.approx([0.30, 0.30, 0.20, 0.20])


@pytest.mark.parametrize(("n", "most"), [(1, 1.0), (2, 0.5), (3, 1 / 3), (4, 0.30)])
def test_cap_of_small_themes(spark, n, most):
    w = weights(spark, [1000, *[1] * (n - 1)])
    assert max(w) == pytest.approx(most)
    assert sum(w) == pytest.approx(1)


def test_attention_opens_closes_and_unknown_resets(spark):
    days = [True, *[False] * 9, None, *[False] * 9, True, *[False] * 10, True]
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate(days)], "key long, day_number long, is_attention boolean")
    got = [(r["first_day"], r["last_day"]) for r in timeseries.attention_islands(s).orderBy("first_day").collect()]
    assert got == [(0, 20), (31, 31)]


def hysteresis_states(rows):
    s = keyed.hysteresis_start()
    return [keyed.hysteresis_step(s, (i, i, float(at), q, closed, expired)) for i, (at, q, closed, expired) in enumerate(rows)]


def test_hysteresis_golden():
    live = [(0, True), (9, True), (10, True), (20, False), (79, False), (80, False), (100, True), (200, None), (300, False), (400, False), (999, False), (1000, False), (1100, True)]
    got = hysteresis_states([(*x, False, False) for x in live])
    assert [s for _, s in got] == ["CANDIDATE", "CANDIDATE", "ACTIVE", "ACTIVE", "ACTIVE", "WEAKENING", "ACTIVE", "ACTIVE", "ACTIVE", "WEAKENING", "WEAKENING", "CLOSED", "CLOSED"]
    assert got[-1][0] == "TERMINAL"
    assert hysteresis_states([(0, None, True, False)])[0] == ("TRANSITIONED", "DISCARDED")
    assert hysteresis_states([(0, True, False, True)])[0] == ("TRANSITIONED", "DISCARDED")
    # an unknown input sets the timer back, and late strength closes
    assert [s for _, s in hysteresis_states([(0, True, 0, 0), (9, None, 0, 0), (11, True, 0, 0), (21, True, 0, 0), (30, False, 0, 0), (90, False, 0, 0), (100, None, 0, 0), (691, True, 0, 0)])][-4:] == ["ACTIVE", "WEAKENING", "WEAKENING", "CLOSED"]
    s = keyed.hysteresis_start()
    steps = [(1, 5, 10.0), (1, 6, 11.0), (2, 5, 12.0), (3, 7, 9.0)]
    assert [keyed.hysteresis_step(s, (*x, True, False, False))[0] for x in steps] == ["NO_TRANSITION", "DUPLICATE", "STALE_SEQUENCE", "STALE_TIME"]


def test_order_fence_golden():
    s = keyed.fence_start()
    rows = [(1, "a", "p", 0, 5, 10, 10, True), (1, "a", "p", 0, 5, 10, 10, True), (1, "a", "q", 0, 5, 10, 10, True), (1, "b", "p", 0, 4, 11, 11, True), (1, "c", "p", 0, 6, 9, 11, True), (1, "d", "p", 1, 1, 12, 9, True), (1, "e", "p", 1, 1, 12, 10, False), (1, "f", "p", 1, 1, 12, 12, False), (2, "g", "p", 0, 1, 20, 20, True), (1, "h", "p", 0, 9, 30, 30, True)]
    want = ["ACCEPTED", "DUPLICATE", "CONFLICT", "OUT_OF_ORDER", "OUT_OF_ORDER", "OLD_OBSERVATION", "OLD_OBSERVATION", "ACCEPTED", "ACCEPTED", "OLD_SESSION"]
    assert [keyed.fence_step(s, r)[0] for r in rows] == want


def test_streamed_hysteresis_equals_the_batch_fold(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 20")
    s = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("arrival"), F.col("event_id").alias("input_id"), F.col("event_id").alias("sequence"), (F.unix_timestamp(F.col("ts").cast("timestamp")) / 400).alias("at"), (F.col("value") > 10).alias("qualifies"), (F.col("event_id") % 97 == 0).alias("market_closed"), F.lit(False).alias("expired"))
    for i in range(3):
        s.where(F.col("arrival") % 900 >= i * 300).where(F.col("arrival") % 900 < (i + 1) * 300).orderBy("arrival").coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part0"))
    q = keyed.stream_hysteresis(stream).writeStream.format("memory").queryName("hysteresis").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted(map(tuple, spark.table("hysteresis").collect()))
    want = keyed.hysteresis(spark.read.parquet(str(tmp_path / "part0")), ["key"], "key long")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 10


def test_stream_counts_as_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = folds.minute_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "40 days")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("windows").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in folds.minute_windows(e.withColumn("ts", F.col("ts"))).collect()}
    assert got == want


def test_days_between_stops_at_unresolved_days(spark):
    # Monday 2024-01-01 to Friday 2024-01-12; Wednesday the 10th has no records
    traded = spark.createDataFrame([(f"2024-01-{i:02d}",) for i in (1, 2, 3, 3, 4, 5, 8, 9, 11, 12)], "day string").select(F.to_date("day").alias("day"))
    calendar = asof.calendar_counts(traded, traded.agg(F.min("day").alias("first")))
    rows = spark.createDataFrame([(1, "2024-01-01", "2024-01-09"), (2, "2024-01-01", "2024-01-10"), (3, "2024-01-09", "2024-01-11"), (4, "2024-01-11", "2024-01-12")], "id long, a string, b string")
    rows = rows.select("id", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    got = {r["id"]: r["n"] for r in asof.days_between(rows, "a", "b", calendar).collect()}
    assert got == {1: 5, 2: 6, 3: None, 4: 0}


def test_fractions_equal_sorting(spark):
    import random

    from tidemark.operators import research

    r = random.Random(6)
    rows = [(k, r.choice([1.5, r.gauss(0, 9), float(r.randint(-3, 3))])) for k in "abc" for _ in range(r.randint(30, 90))] + [("one", 4.0), ("same", 2.0), ("same", 2.0), (None, 1.0), (None, 3.0), ("none", None)]
    got = research.at_fraction(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"low": 0.0, "p25": 0.25, "half": 0.5, "top": 1.0}, 8)
    want = {}
    for k in {k for k, v in rows if v is not None}:
        v = sorted(x for kk, x in rows if kk == k and x is not None)
        want[k] = (len(v), *(v[min(int(len(v) * f), len(v) - 1)] for f in (0.0, 0.25, 0.5, 1.0)))
    assert {x["k"]: tuple(x)[1:] for x in got.collect() if x["k"] is not None} == {k: v for k, v in want.items() if k is not None}
