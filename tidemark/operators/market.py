"""Live theme metrics: guarded returns, rounded weights, turnover against the same time of day, attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK, LEAST = 20, 5
MULTIPLE, STOCK_MULTIPLE, SPREAD, HIGH, RETURN, VALID = 2.0, 2.0, 0.30, 2, 0.01, 3


def stock_return(rows: DataFrame, at: Column, decision: Column) -> DataFrame:
    """rows: one a member, with reference (ref_*) and observation (obs_*) columns, null where there is none. Adds ret, flag and reason: the first guard
    that holds names them, and only without any there is a return. What isn't known refuses: a null flag or day is no licence."""
    r = F.col
    not_said, unless_said = (lambda c: ~F.coalesce(c, F.lit(False))), (lambda c: F.coalesce(c, F.lit(True)))
    guards = (
        (r("ref_known").isNull(), "REFERENCE_PRICE_UNAVAILABLE", "MISSING_REFERENCE_DATA"),
        (not_said(r("ref_resolved")), "CORPORATE_ACTION_UNRESOLVED", "CORPORATE_ACTION_UNRESOLVED"),
        (unless_said((r("ref_for") != at) | (r("ref_known") > decision)), "POINT_IN_TIME_VIOLATION", "MISSING_REFERENCE_DATA"),
        (r("ref_close").isNull() | (r("ref_close") <= 0), "REFERENCE_PRICE_UNAVAILABLE", "MISSING_REFERENCE_DATA"),
        (r("obs_at").isNull(), "MARKET_PRICE_UNAVAILABLE", "MISSING_MARKET_DATA"),
        (unless_said((r("obs_day") != at) | (r("obs_at") > decision)), "POINT_IN_TIME_VIOLATION", "MISSING_MARKET_DATA"),
        (unless_said(r("obs_halted")), "TRADING_HALTED", "TRADING_HALTED"),
        (unless_said(r("obs_unresolved")), "CORPORATE_ACTION_UNRESOLVED", "CORPORATE_ACTION_UNRESOLVED"),
        (not_said(r("obs_fresh")), "STALE_MARKET_DATA", "MISSING_MARKET_DATA"),
        (r("obs_price").isNull() | (r("obs_price") <= 0), "MARKET_PRICE_UNAVAILABLE", "MISSING_MARKET_DATA"),
    )
    flag, reason = F, F
    for holds, f, why in guards:
        flag, reason = flag.when(holds, f), reason.when(holds, why)
    return rows.withColumn("flag", flag).withColumn("reason", reason).withColumn("ret", F.when(F.col("flag").isNull(), F.col("obs_price") / F.col("ref_close") - 1))


def with_residual(weights: DataFrame, limit: Column, places: int = 6) -> DataFrame:
    """Weights rounded to `places`; what their sum lacks of 1 goes to the first stock_id that stays within its limit and above 0."""
    every = Window.partitionBy("theme_id")
    w = weights.withColumn("weight", F.round("weight", places)).withColumn("residual", F.round(1 - F.sum("weight").over(every), places))
    fits = F.when(F.col("residual") > 0, F.col("weight") + F.col("residual") <= limit + 1e-12).otherwise(F.col("weight") + F.col("residual") >= 0)
    first = F.min(F.when(fits, F.col("stock_id"))).over(every)
    return w.withColumn("weight", F.when(F.col("stock_id") == first, F.round(F.col("weight") + F.col("residual"), places)).otherwise(F.col("weight")))


def known_members(members: DataFrame, slots: DataFrame) -> DataFrame:
    """members: theme_id, since. slots: bucket, day_number, each once. How many members each theme has in each slot from its first `since` on.

    Counts by (theme, since) are summed up over since; each sum holds from its day to the next one's, so the days meet the slots by equality."""
    n = members.groupBy("theme_id", "since").agg(F.count("*").alias("n"))
    upward = Window.partitionBy("theme_id").orderBy("since")
    n = n.withColumn("total", F.sum("n").over(upward.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("since").over(upward) - 1)
    first = F.greatest("since", slots.agg(F.min("day_number")).scalar())
    newest = slots.agg(F.max("day_number")).scalar()
    last = F.least(F.coalesce(F.col("until"), newest), newest)
    days = n.where(first <= last).select("theme_id", "total", F.explode(F.sequence(first, last)).alias("day_number"))
    return slots.join(days, "day_number").select("theme_id", "bucket", "day_number", "total")


def theme_turnover(values: DataFrame, members: DataFrame, lookback: int = LOOKBACK, least: int = LEAST) -> DataFrame:
    """values: stock_id, bucket, day_number, value, usable. members: theme_id, stock_id, since (the first day on which the membership was known).

    Per theme, day and bucket: what its members of that day traded, over the medians of the same bucket on the `lookback` days before, of which
    only those count on which the stock was usable and a member as then known; `least` of them and a median above 0 are needed. FULL if
    every member is valid with `lookback` days, INSUFFICIENT without any, else PROVISIONAL. Also how many members trade STOCK_MULTIPLE times their median.
    """
    v = members.join(values, "stock_id").where("day_number >= since")
    w = Window.partitionBy("theme_id", "stock_id", "bucket").orderBy("day_number").rangeBetween(-lookback, -1)
    v = v.withColumn("past", F.array_sort(F.collect_list(F.when(F.col("usable"), F.col("value"))).over(w))).withColumn("n_past", F.size("past"))
    half = F.floor(F.col("n_past") / 2).cast("int")
    mid = F.when(F.col("n_past") % 2 == 1, F.try_element_at("past", half + 1)).otherwise((F.try_element_at("past", F.greatest(half, F.lit(1))) + F.try_element_at("past", half + 1)) / 2)
    v = v.withColumn("baseline", F.when(F.col("usable") & (F.col("n_past") >= least) & (mid > 0), mid))
    valid = F.col("baseline").isNotNull()
    total = known_members(members, values.select("bucket", "day_number").distinct())
    g = v.groupBy("theme_id", "bucket", "day_number").agg(
        F.count_if(valid).alias("valid"), F.sum(F.when(valid, F.col("value"))).alias("now"), F.sum("baseline").alias("usual"), F.min(F.when(valid, F.col("n_past"))).alias("fewest"),
        F.count_if(F.try_divide(F.col("value"), F.col("baseline")) >= STOCK_MULTIPLE).alias("high"),
    )
    out = total.join(g, ["theme_id", "bucket", "day_number"], "left").withColumn("valid", F.coalesce("valid", F.lit(0))).withColumn("high", F.coalesce("high", F.lit(0)))
    status = F.when(F.col("valid") == 0, "INSUFFICIENT").when((F.col("valid") == F.col("total")) & (F.col("fewest") == lookback), "FULL").otherwise("PROVISIONAL")
    return out.withColumn("multiple", F.try_divide("now", "usual")).withColumn("status", status)


def attention_day(rows: DataFrame) -> DataFrame:
    """rows: turnover (multiple, valid, high), coverage and weighted_return of a theme's day. Adds is_attention (null where it can't be told) and reason."""
    reason = F.when(F.col("coverage") != "SUFFICIENT", "INSUFFICIENT_COVERAGE").when(F.col("multiple").isNull() | F.col("weighted_return").isNull() | (F.col("valid") < VALID), "INSUFFICIENT_OBSERVATIONS")
    met = (F.col("multiple") >= MULTIPLE) & (F.col("high") >= HIGH) & (F.col("high") / F.col("valid") >= SPREAD) & (F.col("weighted_return") >= RETURN)
    return rows.withColumn("reason", reason).withColumn("is_attention", F.when(F.col("reason").isNull(), met))


def rank_history(ranks: DataFrame, now: Column, keep: str = "5 minutes") -> DataFrame:
    """Per key the records of the window that ends now, and the newest one before it."""
    since = now - F.expr(f"INTERVAL {keep}")
    old = F.max(F.when(F.col("ts") <= since, F.col("ts"))).over(Window.partitionBy("key"))
    return ranks.where(F.col("ts") <= now).withColumn("old", old).where((F.col("ts") > since) | (F.col("ts") == F.col("old"))).drop("old")


def next_trading_day(days: DataFrame, traded: DataFrame, within: int = 14) -> DataFrame:
    """days, traded: day. The first traded day after each day, null if it is more than `within` days away."""
    both = days.select("day", F.lit(None).cast("date").alias("t")).unionByName(traded.select("day", F.col("day").alias("t")))
    w = both.groupBy("day").agg(F.max("t").alias("t")).withColumn("next_day", F.min("t").over(Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)))
    return days.join(w, "day", "left").select("day", F.when(F.date_diff("next_day", "day") <= within, F.col("next_day")).alias("next_day"))


def recovery_targets(candidates: DataFrame, targets: DataFrame, slots: DataFrame, ttl: str) -> DataFrame:
    """Per slot (start, end) the keys of candidates (key, ts) last seen within ttl of its start, less those that targets (key, ts) hold in it.

    A candidate belongs to every slot from its own to the one ttl later: an explosion by the slots it spans, and one anti-join by slot and key."""
    width = F.unix_timestamp("end") - F.unix_timestamp("start")
    size = slots.select(width.alias("w")).limit(1)
    c = candidates.crossJoin(F.broadcast(size)).withColumn("slot", F.explode(F.sequence(F.floor(F.unix_timestamp("ts") / F.col("w")), F.floor((F.unix_timestamp(F.col("ts") + F.expr(f"INTERVAL {ttl}"))) / F.col("w")))))
    t = targets.crossJoin(F.broadcast(size)).withColumn("slot", F.floor(F.unix_timestamp("ts") / F.col("w")))
    s = slots.withColumn("slot", F.floor(F.unix_timestamp("start") / width)).select("slot", "start")
    wanted = c.select("slot", "key").distinct().join(t.select("slot", "key").distinct(), ["slot", "key"], "left_anti")
    return wanted.join(s, "slot").select("start", "key")
