"""Time-series metrics: forward and daily returns, same-time baselines, attention islands, price corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_returns(prices: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """stock_id, day and fwd_h in percent: the h-th following row's close over this one's; null where it isn't reached."""
    w = Window.partitionBy("stock_id").orderBy("day")
    return prices.select("stock_id", "day", *[(F.try_divide(F.lead("close", h).over(w), F.col("close")) * 100 - 100).alias(f"fwd_{h}") for h in horizons])


def same_time_multiple(values: DataFrame, lookback: int = 20, least: int = 5) -> DataFrame:
    """values: stock_id, bucket, day_number, value. Adds baseline (median of the same bucket over the `lookback` days before)
    and multiple, null with fewer than `least` days."""
    w = Window.partitionBy("stock_id", "bucket").orderBy("day_number").rangeBetween(-lookback, -1)
    v = values.withColumn("past", F.collect_list("value").over(w)).withColumn("n_past", F.size("past"))
    s = F.array_sort("past")
    half = F.floor(F.col("n_past") / 2).cast("int")
    mid = F.when(F.col("n_past") % 2 == 1, F.try_element_at(s, half + 1)).otherwise((F.try_element_at(s, F.greatest(half, F.lit(1))) + F.try_element_at(s, half + 1)) / 2)
    v = v.withColumn("baseline", F.when((F.col("n_past") >= least) & (mid > 0), mid))
    return v.withColumn("multiple", F.try_divide(F.col("value"), F.col("baseline"))).drop("past")


def attention_islands(signals: DataFrame, close_after: int = 10) -> DataFrame:
    """signals: key, day_number, is_attention (true, false, null). Runs of attention: an interval opens on true and ends
    before the first true that follows `close_after` confirmed days without attention in a row; an unknown day sets that count back."""
    by = Window.partitionBy("key").orderBy("day_number")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    # within the days since the last one that isn't a confirmed false, how many false in a row
    reset = F.sum(F.when(F.coalesce(~F.col("is_attention"), F.lit(False)), 0).otherwise(1)).over(upto)
    s = signals.withColumn("reset", reset)
    s = s.withColumn("absent", F.sum(F.when(~F.col("is_attention"), 1).otherwise(0)).over(Window.partitionBy("key", "reset").orderBy("day_number").rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("ended", F.sum(F.when(F.col("absent") == close_after, 1).otherwise(0)).over(upto))
    t = s.where("is_attention").withColumn("starts", F.when(F.lag("ended").over(by).isNull() | (F.col("ended") > F.lag("ended").over(by)), 1).otherwise(0))
    return t.withColumn("island", F.sum("starts").over(upto)).groupBy("key", "island").agg(F.min("day_number").alias("first_day"), F.max("day_number").alias("last_day"), F.count("*").alias("attention_days"))


def factor_events(prices: DataFrame, change: Column, low: float = 0.001, high: float = 1000.0) -> DataFrame:
    """Adds base (close less change), factor (base over the previous close where they differ) and broken."""
    w = Window.partitionBy("stock_id").orderBy("day")
    p = prices.withColumn("base", F.col("close") - change).withColumn("previous", F.lag("close").over(w))
    ratio = F.try_divide(F.col("base"), F.col("previous"))
    broken = F.col("previous").isNotNull() & (F.col("base").isNull() | (F.col("base") <= 0) | ~ratio.between(low, high))
    return p.withColumn("broken", F.coalesce(broken, F.lit(True))).withColumn("factor", F.when(F.col("previous").isNotNull() & ~F.col("broken") & (F.col("base") != F.col("previous")), ratio).otherwise(1.0))


def adjusted_closes(events: DataFrame, places: int | None = 6) -> DataFrame:
    """stock_id, day, adjusted: close times all later factors, to so many places (None: as it is); null before the latest break."""
    later = Window.partitionBy("stock_id").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    scale = F.coalesce(F.product("factor").over(later), F.lit(1.0))
    cut = F.coalesce(F.max("broken").over(later), F.lit(False))
    exact = F.col("close") * scale
    return events.select("stock_id", "day", F.when(~cut, exact if places is None else F.round(exact, places)).alias("adjusted"))


def basket_returns(members: DataFrame, prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """theme_id, day, basket_return: mean over members with a close on the day and on the market's day before."""
    w = Window.partitionBy("stock_id").orderBy("day")
    p = prices.select("stock_id", "day", "close", F.lag("close").over(w).alias("before"), F.lag("day").over(w).alias("before_day"))
    # a stock's row before counts only if it is of the market's day before
    r = p.join(calendar.select("day", "previous_day"), "day").where("before_day = previous_day").select("stock_id", "day", (F.try_divide("close", "before") * 100 - 100).alias("ret"))
    return members.select("theme_id", "stock_id").join(r, "stock_id").groupBy("theme_id", "day").agg(F.avg("ret").alias("basket_return"), F.count("ret").alias("n"))
