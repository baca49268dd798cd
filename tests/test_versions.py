"""Versioned tables under broken and competing writers, and themes drained batch by batch against all at once."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import versions
from tidemark.streaming import drain

FOLDER = "/root/testdata/sf0.001"


def days(spark, year, price):
    return spark.createDataFrame([(year, f"s{i}", float(price + i)) for i in range(5)], "year int, stock string, close double")


def test_versions_are_atomic(spark, tmp_path, monkeypatch):
    s = versions.Versions(spark, str(tmp_path / "t"), {"prices": "year"})
    one = versions.rebuild(s, "prices", days(spark, 2020, 1).union(days(spark, 2021, 2)))
    assert (one["version"], one["rows"], one["written"], one["kept"]) == (1, 10, 2, 0)
    first = s.latest()
    two = versions.rebuild(s, "prices", days(spark, 2021, 9))
    assert (two["version"], two["written"], two["kept"]) == (2, 1, 1)
    assert {(r["year"], r["close"]) for r in s.read("prices").where("stock = 's0'").collect()} == {(2020, 1.0), (2021, 9.0)}
    assert {(r["year"], r["close"]) for r in s.read("prices", first).where("stock = 's0'").collect()} == {(2020, 1.0), (2021, 2.0)}
    # a writer that breaks off after its data
    monkeypatch.setattr(versions.Versions, "_publish", lambda self, m: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        versions.rebuild(s, "prices", days(spark, 2020, 77))
    monkeypatch.undo()
    assert s.latest() == s.manifest(2) and s.read("prices").where("close > 50").count() == 0
    # two writers from one version
    base = s.latest()
    s.commit({"prices": days(spark, 2022, 3)}, base)
    with pytest.raises(versions.Conflict):
        s.commit({"prices": days(spark, 2022, 4)}, base)
    assert s.read("prices").where("year = 2022 and close = 3.0").count() == 1
    s.commit({}, s.latest(), gone={"prices": ["2022"]})
    assert s.read("prices").where("year = 2022").count() == 0 and s.latest()["content"] == two["content"]
    # the same rows, in other files and order, are the same content
    other = versions.Versions(spark, str(tmp_path / "u"), {"prices": "year"})
    versions.rebuild(other, "prices", days(spark, 2021, 9).repartition(3))
    assert versions.rebuild(other, "prices", days(spark, 2020, 1).orderBy(F.desc("stock")))["content"] == two["content"]
    assert versions.rebuild(other, "prices", days(spark, 2020, 2))["content"] != two["content"]


def test_odd_partition_values(spark, tmp_path):
    s = versions.Versions(spark, str(tmp_path / "t"), {"x": "k"})
    rows = spark.createDataFrame([("a/b=c d", 1), (None, 2), ("ü%", 3), ("", 4)], "k string, v int")
    versions.rebuild(s, "x", rows.where("k is not null"))
    versions.rebuild(s, "x", rows.where("k is null"))
    assert {(r["k"], r["v"]) for r in s.read("x").collect()} == {("a/b=c d", 1), (None, 2), ("ü%", 3), ("", 4)}
    assert s.read("x", parts=["ü%"]).count() == 1


@pytest.fixture(scope="module")
def market(spark):
    members = spark.read.parquet(f"{FOLDER}/part.parquet").select(F.col("p_brand").alias("theme_id"), (F.col("p_partkey") % 60).alias("stock_id"))
    e = spark.read.parquet(f"{FOLDER}/events.parquet")
    ticks = e.select((F.col("user_id") % 75).alias("stock_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(F.col("event_id") % 19 != 0, F.col("value")).alias("value"))
    return members, ticks.where("event_id < 400").cache()


def as_rows(df):
    return sorted(((*r[:3], None if r[3] is None else round(r[3], 9), r[4]) for r in df.collect()), key=str)


def test_drain_equals_batch_under_any_split(spark, tmp_path, market, monkeypatch):
    members, ticks = market
    want = as_rows(drain.theme_means_batch(members, ticks))
    rows = ticks.collect()
    random.Random(3).shuffle(rows)  # late ticks too
    s = drain.start(spark, str(tmp_path / "s"), members)
    cuts = [0, 7, 200, 390, len(rows)]
    batches = [spark.createDataFrame(rows[a:b], ticks.schema) for a, b in zip(cuts, cuts[1:], strict=False)]
    for i, b in enumerate(batches[:-1]):
        assert drain.apply_batch(s, members, b, i)
    before = s.latest()
    assert not drain.apply_batch(s, members, batches[2], 2)  # replayed
    monkeypatch.setattr(versions.Versions, "_publish", lambda self, m: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        drain.apply_batch(s, members, batches[3], 3)
    monkeypatch.undo()
    assert s.latest() == before
    assert drain.apply_batch(s, members, batches[3], 3)
    assert as_rows(drain.theme_means(s)) == want
    assert drain.apply_batch(s, members, ticks, 4) and as_rows(drain.theme_means(s)) == want  # all again: nothing is newer


def test_drain_stream(spark, tmp_path, market):
    members, ticks = market
    for i in range(3):
        ticks.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = drain.start(spark, str(tmp_path / "s"), members)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = drain.drain_stream(spark, str(tmp_path / "s"), members, stream, str(tmp_path / "c"))
    assert q.awaitTermination(240) and q.exception() is None
    assert s.latest()["meta"]["batch"] == 2 and as_rows(drain.theme_means(s)) == as_rows(drain.theme_means_batch(members, ticks))
