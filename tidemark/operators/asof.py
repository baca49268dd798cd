"""Point-in-time selection: what was known when. Ties are reported, never broken silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_known(facts: DataFrame, keys: list[str], order: list[str], visible: Column) -> DataFrame:
    """Per key the row of greatest `order` among the visible ones, and `ties`: how many rows share that order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return facts.where(visible).withColumn("place", F.rank().over(w)).where("place = 1").withColumn("ties", F.count("*").over(Window.partitionBy(*keys))).withColumn("row", F.row_number().over(w)).where("row = 1").drop("place", "row")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the right rows' last value at or before its time: one sort over both sides, no range join.
    On equal times the right row counts as before the left one; among equal right times the greatest value is last."""
    both = left.select(F.col(key), F.col(at), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias("seen")).unionByName(
        right.select(F.col(key), F.col(at), F.lit(0).alias("side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("row"), F.col(value).alias("seen"))
    )
    w = Window.partitionBy(key).orderBy(at, "side", "seen").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("asof_value", F.last("seen", ignorenulls=True).over(w)).where("side = 1").select("row.*", "asof_value")


def name_windows(rows: DataFrame, code: str, name: str, day: Column) -> DataFrame:
    """Per code and name: first and last day, number of days."""
    return rows.groupBy(code, name).agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.countDistinct(day).alias("day_count"))


def previous_days(days: DataFrame, day: str = "day") -> DataFrame:
    """Calendar of distinct trading days with each one's predecessor. One row a day in the calendar's whole life."""
    w = Window.orderBy(day)
    return days.select(day).distinct().withColumn("previous_day", F.lag(day).over(w)).withColumn("day_number", F.row_number().over(w).cast("long"))


def resolve_alias(queries: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Names valid on a query's day: RESOLVED for one, AMBIGUOUS for several, OUT_OF_VALIDITY for none."""
    met = queries.join(windows, key, "left").withColumn("valid", F.coalesce(F.col("day").between(F.col("first_date"), F.col("last_date")), F.lit(False)))
    n = F.countDistinct(F.when(F.col("valid"), F.col("name")))
    return met.groupBy(key, "day").agg(n.alias("n_valid")).withColumn("status", F.when(F.col("n_valid") == 1, "RESOLVED").when(F.col("n_valid") > 1, "AMBIGUOUS").otherwise("OUT_OF_VALIDITY"))


def calendar_counts(traded: DataFrame, since: DataFrame) -> DataFrame:
    """Every day from the first to the last one in traded (day; one row a record) and since (one row, one day), with whether it is open or
    unresolved and both counts up to it. A day with records is open, a weekend without is closed, a weekday without is unresolved.
    The window holds one row a day."""
    seen = traded.groupBy("day").agg(F.count("*").alias("records"))
    every = seen.select("day").union(since).agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    marked = every.join(seen, "day", "left").select("day", F.col("records").isNotNull().cast("long").alias("open"), (F.col("records").isNull() & (F.weekday("day") < 5)).cast("long").alias("unresolved"))
    return marked.withColumn("opened", F.sum("open").over(upto)).withColumn("unresolved_days", F.sum("unresolved").over(upto))


def days_between(rows: DataFrame, start: str, end: str, calendar: DataFrame) -> DataFrame:
    """Adds n: open days strictly between start and end (later than start); null if any day between is unresolved."""
    a = calendar.select(F.col("day").alias(start), F.col("opened").alias("from_open"), F.col("unresolved_days").alias("from_unresolved"))
    b = calendar.select(F.col("day").alias(end), (F.col("opened") - F.col("open")).alias("to_open"), (F.col("unresolved_days") - F.col("unresolved")).alias("to_unresolved"))
    n = F.when(F.col("to_unresolved") == F.col("from_unresolved"), F.col("to_open") - F.col("from_open"))
    return rows.join(a, start).join(b, end).withColumn("n", n).drop("from_open", "from_unresolved", "to_open", "to_unresolved")
