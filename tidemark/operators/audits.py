"""Audits of captured ticks: order, gaps and digests over ranges of numbers, and coverage by intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: So many numbers make a chunk. Chunks are read in parallel; what spans them goes over one row a chunk and kind.
CHUNK = 4096


def with_chunk(ticks: DataFrame, seq: str = "seq", size: int = CHUNK) -> DataFrame:
    return ticks.withColumn("chunk", F.floor(F.col(seq) / size))


def ordered_digest(rows: DataFrame, seq: str, content: Column, size: int = CHUNK) -> DataFrame:
    """One row: n, first_seq, last_seq, missing (numbers absent between them), holes (places where some are) and digest.

    The digest is a tree: SHA-256 of the contents' hashes of a chunk in order of number, then of the chunks' digests, a chunk's number of them at a time, until one
    is left (two levels at least). Any change, loss or swap changes it, and no task sees more than a chunk. seq is unique.
    """
    c = with_chunk(rows.select(F.col(seq).alias("seq"), F.sha2(content, 256).alias("h")), size=size)
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x["h"]), "")
    before = F.lag("seq").over(Window.partitionBy("chunk").orderBy("seq"))
    c = c.withColumn("hole", F.col("seq") > before + 1)
    level = c.groupBy("chunk").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_if("hole").alias("holes"), F.sha2(joined(F.collect_list(F.struct("seq", "h"))), 256).alias("h"))
    # a chunk begins in a hole unless the number before its first one is another chunk's last
    ends = level.select((F.col("last") + 1).alias("first"), F.lit(1).alias("follows"))
    level = level.join(ends, "first", "left")
    reach = rows.agg(F.floor(F.min(seq) / size).alias("lo"), F.floor(F.max(seq) / size).alias("hi")).collect()[0]
    lo, hi = (reach["lo"] or 0), (reach["hi"] or 0)
    level = level.select("chunk", "n", "first", "last", (F.col("holes") + F.when(F.col("follows").isNull(), 1).otherwise(0)).alias("holes"), "h")
    while True:
        up = level.withColumn("chunk", F.floor(F.col("chunk") / size))
        level = up.groupBy("chunk").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("holes").alias("holes"), F.sha2(joined(F.collect_list(F.struct("first", "h"))), 256).alias("h"))
        lo, hi = lo // size, hi // size
        if lo == hi:
            break
    return level.select("n", F.col("first").alias("first_seq"), F.col("last").alias("last_seq"), (F.col("last") - F.col("first") + 1 - F.col("n")).alias("missing"), (F.col("holes") - 1).alias("holes"), F.col("h").alias("digest"))


def since_last(ticks: DataFrame, at: str = "at", order: tuple[str, ...] = ("seq",), chunk: Column | None = None) -> DataFrame:
    """ticks: kind, time `at` and the columns of order. Adds before: the time of the kind's tick before this one in that order. A window within chunks (of
    numbers, unless another one is given that grows with the order); the first of a kind in its chunk takes the kind's last one of the chunks
    before, from a table with a row a chunk and kind."""
    c = ticks.withColumn("chunk", F.floor(F.col(order[0]) / CHUNK) if chunk is None else chunk)
    inside = Window.partitionBy("chunk", "kind").orderBy(*order)
    ends = c.groupBy("kind", "chunk").agg(F.max_by(at, F.struct(*order)).alias("end"))
    carried = ends.select("kind", "chunk", F.lag("end").over(Window.partitionBy("kind").orderBy("chunk")).alias("carried"))
    c = c.withColumn("before", F.lag(at).over(inside)).withColumn("first", F.row_number().over(inside) == 1).join(carried, ["kind", "chunk"])
    return c.withColumn("before", F.when(F.col("first"), F.col("carried")).otherwise(F.col("before"))).drop("chunk", "first", "carried")


def nearest_ranks(rows: DataFrame, key: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """Per key the value of nearest rank for each fraction: counts by value first, then running counts over the different values."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    n = n.withColumn("upto", F.sum("n").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(key)))
    return n.groupBy(key).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * f), F.col(value))).alias(name) for name, f in fractions.items()])


def union_of(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: intervals that overlap or touch become one. Intervals without length, or with a null end, count for nothing."""
    i = intervals.where("start < end").select(*keys, "start", "end")
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    i = i.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def uncovered(wanted: DataFrame, covering: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: what of the wanted intervals no covering one covers. A sweep: bounds of both sides in one order, running counts of what is open."""
    steps = lambda df, side: [df.where("start < end").select(*keys, F.col(e).alias("at"), F.lit(by if side == 0 else 0).alias("want"), F.lit(by if side else 0).alias("cover")) for e, by in (("start", 1), ("end", -1))]
    a, b, c, d = [*steps(wanted, 0), *steps(covering, 1)]
    bounds = a.union(b).union(c).union(d).groupBy(*keys, "at").agg(F.sum("want").alias("want"), F.sum("cover").alias("cover"))
    w = Window.partitionBy(*keys).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = bounds.select(*keys, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), ((F.sum("want").over(upto) > 0) & (F.sum("cover").over(upto) == 0)).alias("open"))
    return union_of(x.where("open"), keys)
