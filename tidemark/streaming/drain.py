"""Themes recomputed batch by batch: hot state and theme sums kept as versioned tables, moved by what changed alone.

A theme's row holds mergeable sums in exact decimals. A batch takes the newest value of each stock it names; where that is newer than the
state's, the old value is subtracted from the sums of the stock's themes and the new one added. State and sums change in
one commit that carries the batch's number: a batch that fails leaves the version before, one that is replayed changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import Versions

#: State is spread over so many partitions; a batch rewrites those it touches.
BUCKETS = 32
_EXACT = "decimal(38,6)"


def _bucket(key: str):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def store(spark: SparkSession, path: str) -> Versions:
    return Versions(spark, path, {"hot": "bucket", "themes": "bucket"})


def start(spark: SparkSession, path: str, members: DataFrame) -> Versions:
    """members: theme_id, stock_id. The first version: every theme with its number of members and nothing observed."""
    s = store(spark, path)
    themes = members.groupBy("theme_id").agg(F.countDistinct("stock_id").alias("total")).select("theme_id", "total", F.lit(0).cast("long").alias("observed"), F.lit(0).cast(_EXACT).alias("sum"), F.lit(None).cast("timestamp").alias("as_of"), _bucket("theme_id").alias("bucket"))
    stock = members.schema["stock_id"].dataType.simpleString()
    hot = spark.createDataFrame([], f"stock_id {stock}, ts timestamp, event_id long, value {_EXACT}, bucket int")
    s.commit({"hot": hot, "themes": themes}, s.latest(), {"batch": -1})
    return s


def apply_batch(s: Versions, members: DataFrame, ticks: DataFrame, batch: int) -> bool:
    """ticks: stock_id, ts, event_id, value. False if the batch is in already. Ticks older than the state's (by ts, then event_id) and null values change nothing."""
    base = s.latest()
    if base["meta"].get("batch", -1) >= batch:
        return False
    new = ticks.where("value is not null").groupBy("stock_id").agg(F.max(F.struct("ts", "event_id", F.round("value", 6).cast(_EXACT).alias("value"))).alias("new"))
    new = new.withColumn("bucket", _bucket("stock_id")).persist()
    try:
        touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        hot = s.read("hot", base, touched)
        old = hot.select("stock_id", F.struct("ts", "event_id", "value").alias("old"))
        moved = new.join(old, "stock_id", "left").where("old is null or struct(new.ts, new.event_id) > struct(old.ts, old.event_id)")
        changes = moved.select("stock_id", "bucket", "new", "old")
        kept = hot.join(changes.select("stock_id"), "stock_id", "left_anti")
        hot_after = kept.unionByName(changes.select("stock_id", "new.ts", "new.event_id", "new.value", "bucket"))
        moves = changes.join(members.select("theme_id", "stock_id").distinct(), "stock_id").groupBy("theme_id").agg(
            F.sum(F.col("new.value") - F.coalesce("old.value", F.lit(0).cast(_EXACT))).alias("more"), F.count_if(F.col("old").isNull()).alias("first"), F.max("new.ts").alias("newest")
        )
        moves = moves.withColumn("bucket", _bucket("theme_id")).persist()
        dirty = [str(r[0]) for r in moves.select("bucket").distinct().collect()]
        themes = s.read("themes", base, dirty).join(moves.drop("bucket"), "theme_id", "left")
        themes_after = themes.select(
            "theme_id", "total", (F.col("observed") + F.coalesce("first", F.lit(0))).alias("observed"), (F.col("sum") + F.coalesce("more", F.lit(0).cast(_EXACT))).cast(_EXACT).alias("sum"), F.greatest("as_of", "newest").alias("as_of"), "bucket"
        )
        s.commit({"hot": hot_after, "themes": themes_after}, base, {"batch": batch})
        moves.unpersist()
    finally:
        new.unpersist()
    return True


def drain_stream(spark: SparkSession, path: str, members: DataFrame, ticks: DataFrame, checkpoint: str) -> StreamingQuery:
    """The stream's twin: each micro-batch is one commit, numbered by Spark; a restart replays the last batch, which then changes nothing."""
    s = store(spark, path)
    return ticks.writeStream.foreachBatch(lambda df, batch: apply_batch(s, members, df, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def theme_means(s: Versions) -> DataFrame:
    """theme_id, total, observed, mean, as_of of the latest version."""
    t = s.read("themes")
    return t.select("theme_id", "total", "observed", F.when(F.col("observed") > 0, F.col("sum").cast("double") / F.col("observed")).alias("mean"), "as_of")


def theme_means_batch(members: DataFrame, ticks: DataFrame) -> DataFrame:
    """The same from all ticks at once."""
    hot = ticks.where("value is not null").groupBy("stock_id").agg(F.max(F.struct("ts", "event_id", F.round("value", 6).cast(_EXACT).alias("value"))).alias("new"))
    g = members.select("theme_id", "stock_id").distinct().join(hot, "stock_id", "left").groupBy("theme_id")
    g = g.agg(F.count("*").alias("total"), F.count("new").alias("observed"), F.sum("new.value").alias("sum"), F.max("new.ts").alias("as_of"))
    return g.select("theme_id", "total", "observed", (F.col("sum").cast("double") / F.col("observed")).alias("mean"), "as_of")
