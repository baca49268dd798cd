"""Timers: streams against their batch twins, and golden moves that no input makes."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import keyed, timers


def moves(rows, until):
    s, out = keyed.hysteresis_start(), []
    for i, (at, q, closed) in enumerate(rows):
        out += timers.take(s, (i, i, float(at), q, closed, False))
    return [(at, state) for at, _, d, state in out + timers.come_due(s, until) if d in ("TIMER", "FORGOTTEN", "TRANSITIONED")]


def test_holds_end_without_a_further_input():
    assert moves([(0, True, False)], 9.9) == []
    assert moves([(0, True, False)], 50) == [(10.0, "ACTIVE")]
    assert moves([(0, True, False), (20, False, False)], 2000) == [(10.0, "ACTIVE"), (80.0, "WEAKENING"), (680.0, "CLOSED")]
    assert moves([(0, True, False), (20, False, False), (300, True, False)], 400) == [(10.0, "ACTIVE"), (80.0, "WEAKENING"), (300.0, "ACTIVE")]
    # an input that comes after the close meets a closed event, and after an hour a new one
    assert moves([(0, True, False), (20, False, False), (700, True, False)], 701) == [(10.0, "ACTIVE"), (80.0, "WEAKENING"), (680.0, "CLOSED")]
    assert moves([(0, True, True), (9000, True, False)], 9020) == [(0.0, "DISCARDED"), (3600.0, None), (9010.0, "ACTIVE")]
    assert moves([(0, True, False), (5, None, False)], 100) == []  # unknown sets the hold back


def stream_of(spark, df, folder, order, files):
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // files)
    for i in range(0, len(rows), step):
        part = spark.createDataFrame(rows[i : i + step], df.schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(scope="module")
def rocks(spark):
    name, value = timers.STATE_STORE
    old = spark.conf.get(name)
    spark.conf.set(name, value)
    yield spark
    spark.conf.set(name, old)


def finish(q):
    assert q.awaitTermination(300) and q.exception() is None


@pytest.mark.parametrize("files", [1, 5])
def test_stream_with_timers_equals_batch(rocks, tmp_path, files):
    spark = rocks
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 12")
    s = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("input_id"), F.col("event_id").alias("sequence"), F.round(F.unix_timestamp(F.col("ts").cast("timestamp")) / 400.0, 3).alias("at"), (F.col("value") > 10).alias("qualifies"), (F.col("event_id") % 97 == 0).alias("market_closed"), F.lit(False).alias("expired"))
    s = s.withColumn("moment", F.timestamp_millis((F.col("at") * 1000).cast("long"))).cache()
    end = s.agg(F.max("at")).collect()[0][0]
    # a last row of another key moves the watermark to the end
    last = s.limit(1).select(F.lit(-1).cast("long").alias("key"), F.lit(0).cast("long").alias("input_id"), F.lit(0).cast("long").alias("sequence"), F.lit(end + 100.0).alias("at"), F.lit(None).cast("boolean").alias("qualifies"), F.lit(False).alias("market_closed"), F.lit(False).alias("expired"))
    s = s.unionByName(last.withColumn("moment", F.timestamp_millis((F.col("at") * 1000).cast("long"))))
    stream = stream_of(spark, s, str(tmp_path / "in"), "at", files)
    q = timers.stream_hysteresis_with_timers(stream, "0 seconds").writeStream.format("memory").queryName(f"timers{files}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    finish(q)
    got = sorted(map(repr, (tuple(r) for r in spark.table(f"timers{files}").collect())))
    want = timers.hysteresis_with_timers(s, end + 99.999).collect()
    assert got == sorted(map(repr, map(tuple, want)))
    assert sum(r["disposition"] == "TIMER" for r in want) > 20


def test_candidates_expire_on_the_stream(rocks, tmp_path):
    spark = rocks
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type in ('signup', 'view', 'click')")
    s = e.select((F.col("user_id") % 10).alias("stock"), F.col("event_type").alias("condition"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), (F.col("event_id") % 3 != 0).alias("enters"), "event_id")
    end = s.agg(F.max("at")).collect()[0][0]
    s = s.unionByName(s.limit(1).select(F.lit(-1).cast("long").alias("stock"), F.lit("x").alias("condition"), F.lit(end + 1e6).alias("at"), F.lit(False).alias("enters"), F.lit(0).cast("long").alias("event_id")))
    s = s.withColumn("moment", F.timestamp_millis((F.col("at") * 1000).cast("long")))
    ttl = 6 * 3600.0
    q = timers.stream_candidates(stream_of(spark, s, str(tmp_path / "in"), "at", 4), ttl, "0 seconds").writeStream.format("memory").queryName("candidates").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    finish(q)
    got = sorted(map(repr, map(tuple, spark.table("candidates").collect())))
    want = timers.candidates(s, ttl, end + 1e6 - 1).collect()
    assert got == sorted(map(repr, map(tuple, want)))
    assert {r["change"] for r in want} == {"ENTERED", "KEPT", "LEFT", "EXPIRED"}
    alive = {}
    for r in sorted(want, key=lambda r: (r["stock"], r["at"])):
        alive[r["stock"]] = r["conditions"]
    assert set(alive.values()) == {0}  # after the end all have expired
