"""Hot state, merged sources, windows and deduplication of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_state(events: DataFrame) -> DataFrame:
    """Hot state: per key the greatest (ts, event_id) with the count of applied and of stale updates (arrival by event_id)."""
    arrived = Window.partitionBy("user_id").orderBy("event_id")
    seen = F.max("ts").over(arrived.rowsBetween(Window.unboundedPreceding, -1))
    e = events.withColumn("stale", F.coalesce(F.col("ts") < seen, F.lit(False)))
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"), F.count_if(~F.col("stale")).alias("applied"), F.count_if("stale").alias("stale"))


def merged(sources: list[DataFrame], at: str, tie: str) -> DataFrame:
    """Sources in one order: by time, then source number, then `tie`; position within the day, which is counted in two steps (within the minute,
    then minutes of a day), so that no task sorts a whole day."""
    both = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(i))
        both = s if both is None else both.unionByName(s)
    both = both.withColumn("minute", F.date_trunc("minute", at))
    counts = both.groupBy("minute").agg(F.count("*").alias("c"))
    ahead = Window.partitionBy(F.to_date("minute")).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("c").over(ahead), F.lit(0))).drop("c")
    inside = F.row_number().over(Window.partitionBy("minute").orderBy(at, "source_rank", tie))
    return both.withColumn("inside", inside).join(counts, "minute").withColumn("position", F.col("ahead") + F.col("inside")).drop("minute", "inside", "ahead")


def minute_windows(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Streaming or batch: events per window and type; on a stream, those later than `late` are dropped with their window's state."""
    s = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return s.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def deduplicated(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
