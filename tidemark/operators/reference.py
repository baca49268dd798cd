"""Reference data as then known: snapshots, revisions, prices, shares, holdings, free float. Doubt shows in a state, never in a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_DAYS = 180
COVERAGE = 0.8
REQUIRED = ("CONTROLLING_HOLDER", "TREASURY")
LOOK_BACK = 370


def on_top(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key all rows that share the greatest order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("place", F.rank().over(w)).where("place = 1").drop("place")


def agreed(rows: DataFrame, keys: list[str], order: list[str], payload: str, *more: str) -> DataFrame:
    """Per key the payload of the rows of greatest order: state KNOWN, or CONFLICT and null if they hold several payloads."""
    top = on_top(rows, keys, order).groupBy(*keys).agg(F.countDistinct(payload).alias("payloads"), F.max(payload).alias(payload), *[F.max(c).alias(c) for c in more])
    return top.withColumn(payload, F.when(F.col("payloads") == 1, F.col(payload))).withColumn("state", F.when(F.col("payloads") == 1, "KNOWN").otherwise("CONFLICT")).drop("payloads")


def membership(snapshots: DataFrame, at: Column, decision: Column) -> DataFrame:
    """Rows (theme_id, stock_id, effective_from, known_at, version) of each theme's snapshot in force: latest (effective_from, known_at, version)
    that was effective and known. AMBIGUOUS if several versions share the first two."""
    seen = snapshots.where((F.col("effective_from") <= at) & (F.col("known_at") <= decision))
    top = on_top(seen, ["theme_id"], ["effective_from", "known_at"])
    versions = top.groupBy("theme_id").agg(F.countDistinct("version").alias("versions"), F.max("version").alias("version"))
    return top.join(versions, ["theme_id", "version"]).withColumn("status", F.when(F.col("versions") > 1, "AMBIGUOUS").otherwise("RESOLVED")).drop("versions")


def known_intervals(facts: DataFrame) -> DataFrame:
    """Adds known_to: when the next revision of the same stock and effective day became known; open for the last."""
    w = Window.partitionBy("stock_id", "effective_on").orderBy("known_at", "revision")
    return facts.withColumn("known_to", F.lead("known_at").over(w))


def store_as_of(facts: DataFrame, at: Column, decision: Column) -> DataFrame:
    """Per stock the fact of greatest (effective_on, known_at, revision) whose known interval holds the decision."""
    w = Window.partitionBy("stock_id").orderBy(F.col("effective_on").desc(), F.col("known_at").desc(), F.col("revision").desc(), F.col("value").desc())
    held = known_intervals(facts).where((F.col("effective_on") <= at) & (F.col("known_at") <= decision) & (F.col("known_to").isNull() | (F.col("known_to") > decision)))
    return held.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def return_reference(close: Column, effective_matches: Column, known: Column, action_resolved: Column) -> Column:
    return F.when(effective_matches & known & action_resolved & (close > 0), close)


def free_float_cap(close: Column, shares: Column, ratio: Column, validated: Column) -> Column:
    return F.when(validated & (close > 0) & (shares > 0) & (ratio > 0), close * shares * ratio)


def resolve_calendar(records: DataFrame, decision: Column) -> DataFrame:
    """records: day, source, is_open, known_at, revision. Per day OPEN, CLOSED, CONFLICT (sources disagree) or POINT_IN_TIME_UNAVAILABLE
    (nothing known yet)."""
    days = records.select("day").distinct()
    top = on_top(records.where(F.col("known_at") <= decision), ["day", "source"], ["known_at", "revision"])
    flags = top.groupBy("day").agg(F.min("is_open").alias("least"), F.max("is_open").alias("most"))
    state = F.when(F.col("most").isNull(), "POINT_IN_TIME_UNAVAILABLE").when(F.col("least") != F.col("most"), "CONFLICT").when(F.col("most"), "OPEN").otherwise("CLOSED")
    return days.join(flags, "day", "left").select("day", state.alias("state"))


def guarded_previous_day(calendar: DataFrame) -> DataFrame:
    """calendar: day, open (0, 1), unresolved (0, 1), one row a day. The last open day before each one, LOOK_BACK days back at most;
    null if an unresolved day stands nearer."""
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    c = calendar.withColumn("last_open", F.max(F.when(F.col("open") == 1, F.col("day"))).over(before)).withColumn("last_unresolved", F.max(F.when(F.col("unresolved") == 1, F.col("day"))).over(before))
    usable = (F.col("last_unresolved").isNull() | (F.col("last_unresolved") < F.col("last_open"))) & (F.date_diff("day", "last_open") <= LOOK_BACK)
    return c.select("day", F.when(usable, F.col("last_open")).alias("previous_day"))


def listed_shares(stocks: DataFrame, facts: DataFrame, at: Column, decision: Column, stale_days: int = STALE_DAYS) -> DataFrame:
    """Per stock the value of the source of first priority (least name); CONFLICT if the sources' latest values disagree,
    STALE if the chosen one is older than stale_days, MISSING without any."""
    seen = facts.where((F.col("effective_on") <= at) & (F.col("known_at") <= decision))
    latest = agreed(seen, ["stock_id", "source"], ["effective_on", "known_at", "revision"], "value", "effective_on")
    per = latest.groupBy("stock_id").agg(F.min(F.struct("source", "effective_on", "value")).alias("first"), F.countDistinct("value").alias("values"), F.max((F.col("state") == "CONFLICT").cast("int")).alias("torn"))
    state = F.when(F.col("first").isNull(), "MISSING").when((F.col("values") > 1) | (F.col("torn") == 1), "CONFLICT").when(F.date_diff(at, F.col("first.effective_on")) > stale_days, "STALE").otherwise("VERIFIED")
    return stocks.join(per, "stock_id", "left").select("stock_id", state.alias("state"), F.when(state.isin("VERIFIED", "STALE"), F.col("first.value")).alias("value"), F.col("first.effective_on").alias("effective_on"))


def holding_coverage(stocks: DataFrame, coverage: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """coverage: stock_id, category, source, effective_on, known_at, revision, complete. Per stock and required category the latest row of each
    source, of these the latest day, then the source of first priority; what is incomplete or absent is missing."""
    wanted = stocks.withColumn("category", F.explode(F.array(*[F.lit(c) for c in required])))
    per = on_top(coverage, ["stock_id", "category", "source"], ["effective_on", "known_at", "revision"])
    w = Window.partitionBy("stock_id", "category").orderBy(F.col("effective_on").desc(), "source", "complete")
    best = per.withColumn("place", F.row_number().over(w)).where("place = 1").select("stock_id", "category", "source", "effective_on", "complete")
    met = wanted.join(best, ["stock_id", "category"], "left")
    return met.withColumn("state", F.when(F.col("complete"), "COVERED").otherwise("MISSING"))


def select_holdings(facts: DataFrame) -> DataFrame:
    """facts: stock_id, holder, source, effective_on, known_at, revision, shares. Of each stock the latest disclosure day, wholesale; per
    holder and source the latest revision; sources that agree are one holding, others a CONFLICT."""
    newest = facts.withColumn("newest", F.max("effective_on").over(Window.partitionBy("stock_id"))).where("effective_on = newest")
    per = agreed(newest, ["stock_id", "holder", "source"], ["known_at", "revision"], "shares", "effective_on")
    one = per.groupBy("stock_id", "holder").agg(F.max("effective_on").alias("effective_on"), F.countDistinct("shares").alias("values"), F.max((F.col("state") == "CONFLICT").cast("int")).alias("torn"), F.max("shares").alias("shares"), F.count("*").alias("sources"))
    state = F.when((F.col("values") == 1) & (F.col("torn") == 0), "AGREED").otherwise("CONFLICT")
    return one.select("stock_id", "holder", "effective_on", "sources", state.alias("state"), F.when(state == "AGREED", F.col("shares")).alias("shares"))


def free_float(issued: DataFrame, holdings: DataFrame, coverage: DataFrame) -> DataFrame:
    """issued: stock_id, state, value. ratio = (issued - holdings) / issued. States in order: CONFLICT, MISSING, STALE, CONFLICT (more held than
    issued), VERIFIED; a ratio only where VERIFIED."""
    held = holdings.groupBy("stock_id").agg(F.sum("shares").alias("held"), F.max((F.col("state") == "CONFLICT").cast("int")).alias("torn"))
    gaps = coverage.groupBy("stock_id").agg(F.max((F.col("state") == "MISSING").cast("int")).alias("gap"))
    x = issued.join(held, "stock_id", "left").join(gaps, "stock_id", "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
    state = (
        F.when((F.col("state") == "CONFLICT") | (F.coalesce("torn", F.lit(0)) == 1), "CONFLICT")
        .when((F.col("state") == "MISSING") | (F.coalesce("gap", F.lit(1)) == 1), "MISSING")
        .when(F.col("state") == "STALE", "STALE")
        .when(F.col("held") > F.col("value"), "CONFLICT")
        .otherwise("VERIFIED")
    )
    return x.withColumn("float_state", state).select("stock_id", F.col("float_state").alias("state"), F.when(F.col("float_state") == "VERIFIED", F.try_divide(F.col("value") - F.col("held"), F.col("value"))).alias("ratio"))


def reference_coverage(members: DataFrame, references: DataFrame, ratio: float = COVERAGE) -> DataFrame:
    """Per theme how many members have a verified reference, and which are missing, stale or in conflict (sorted)."""
    m = members.select("theme_id", "stock_id").join(references.select("stock_id", "state"), "stock_id", "left").withColumn("state", F.coalesce("state", F.lit("MISSING")))
    codes = lambda s: F.array_join(F.transform(F.sort_array(F.collect_set(F.when(F.col("state") == s, F.col("stock_id")))), lambda c: c.cast("string")), ",")
    g = m.groupBy("theme_id").agg(F.count("*").alias("total"), F.count_if(F.col("state") == "VERIFIED").alias("observed"), codes("MISSING").alias("missing"), codes("STALE").alias("stale"), codes("CONFLICT").alias("conflict"))
    share = F.col("observed") / F.col("total")
    return g.withColumn("status", F.when(share >= ratio, "SUFFICIENT").when(F.col("observed") > 0, "PARTIAL").otherwise("INSUFFICIENT"))


def previous_adjusted_close(stocks: DataFrame, base: DataFrame, closes: DataFrame, actions: DataFrame) -> DataFrame:
    """First choice the base price that the exchange implies; else the last close times the action's factor; else a state that says what lacks.

    base: stock_id, base. closes: stock_id, close, state. actions: stock_id, factor, state."""
    x = stocks.join(base, "stock_id", "left").join(closes.select("stock_id", "close", F.col("state").alias("close_state")), "stock_id", "left").join(actions.select("stock_id", "factor", F.col("state").alias("action_state")), "stock_id", "left")
    state = (
        F.when(F.col("base") > 0, "IMPLIED_BASE")
        .when(F.col("close_state").isNull(), "CLOSE_MISSING")
        .when(F.col("close_state") == "CONFLICT", "CLOSE_CONFLICT")
        .when(F.col("action_state") == "CONFLICT", "ACTION_CONFLICT")
        .when(F.col("action_state").isNull(), "UNADJUSTED_CLOSE")
        .otherwise("ADJUSTED_CLOSE")
    )
    value = F.when(state == "IMPLIED_BASE", F.col("base")).when(state == "UNADJUSTED_CLOSE", F.col("close")).when(state == "ADJUSTED_CLOSE", F.col("close") * F.col("factor"))
    return x.select("stock_id", state.alias("state"), value.alias("value"))


def supplemented(references: DataFrame, stream: DataFrame) -> DataFrame:
    """references: stock_id, close. Stocks without one get the first base_price of the stream (stock_id, at, base_price); none is overwritten."""
    first = stream.where("base_price > 0").groupBy("stock_id").agg(F.min(F.struct("at", "base_price")).alias("f")).select("stock_id", F.col("f.base_price").alias("close"))
    have = references.where("close is not null")
    return have.withColumn("origin", F.lit("REFERENCE")).unionByName(first.join(have, "stock_id", "left_anti").withColumn("origin", F.lit("STREAM")))
