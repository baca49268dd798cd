"""Cross-sectional theme metrics: capped weights, returns, breadth, coverage, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP = 0.30
MIN_CORE, MIN_TOTAL, CORE_WEIGHT, TOTAL_COUNT = 2, 3, 0.80, 0.70


def capped_weights(members: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds weight: in proportion to cap value, none above max(cap, 1/n) of its theme; what is cut goes to the rest.

    Closed form of the repeated proposal: in order of value, a member is fixed at the limit as long as its share of
    what its predecessors left is above the limit; the others share the remainder. Sums run along a theme's order, what is
    left of it from its end, so that no row reads the others again.
    """
    down = Window.partitionBy("theme_id").orderBy(F.col("cap").desc(), "stock_id")
    up = Window.partitionBy("theme_id").orderBy(F.col("cap").asc_nulls_first(), F.col("stock_id").desc_nulls_last())
    every = Window.partitionBy("theme_id")
    m = members.withColumn("n", F.count("*").over(every)).withColumn("limit", F.greatest(F.lit(cap), 1 / F.col("n"))).withColumn("i", F.row_number().over(down))
    m = m.withColumn("rest", F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("fixed", F.coalesce(F.col("cap") * (1 - (F.col("i") - 1) * F.col("limit")) > F.col("limit") * F.col("rest"), F.lit(False)))
    m = m.withColumn("fixed", F.min("fixed").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("k", F.sum(F.col("fixed").cast("int")).over(every)).withColumn("free", F.sum(F.when(~F.col("fixed"), F.col("cap"))).over(every))
    return m.withColumn("weight", F.when(F.col("fixed"), F.col("limit")).otherwise(F.try_divide(F.col("cap") * (1 - F.col("k") * F.col("limit")), F.col("free")))).drop("n", "limit", "i", "rest", "fixed", "k", "free")


def theme_metrics(members: DataFrame, returns: DataFrame) -> DataFrame:
    """Per theme: weighted and median return, breadth, coverage. Stocks without a return stay out, with nothing put in their place; a core member without a cap leaves the
    core ratio unknown."""
    m = members.join(returns, "stock_id", "left")
    valid = capped_weights(m.where("ret is not null")).groupBy("theme_id").agg(F.sum(F.col("weight") * F.col("ret")).alias("weighted_return"), F.median("ret").alias("median_return"), F.count_if(F.col("ret") > 0).alias("advancing"), F.count("*").alias("valid"))
    core = F.col("role") == "CORE"
    seen = F.col("ret").isNotNull()
    cover = m.groupBy("theme_id").agg(F.count("*").alias("total"), F.count_if(core).alias("core"), F.when(F.count_if(core & F.col("cap").isNull()) == 0, F.try_divide(F.sum(F.when(core & seen, F.col("cap")).otherwise(0.0)), F.sum(F.when(core, F.col("cap"))))).alias("core_ratio"), (F.count_if(seen) / F.count("*")).alias("total_ratio"), F.count_if(core & seen).alias("core_seen"))
    status = F.when(F.col("core_ratio").isNull() | (F.col("core_seen") < MIN_CORE) | (F.col("valid") < MIN_TOTAL), "INSUFFICIENT").when((F.col("core_ratio") >= CORE_WEIGHT) & (F.col("total_ratio") >= TOTAL_COUNT), "SUFFICIENT").otherwise("PARTIAL")
    out = cover.join(valid, "theme_id", "left").withColumn("valid", F.coalesce("valid", F.lit(0))).withColumn("breadth", F.try_divide(F.col("advancing"), F.col("valid")))
    return out.withColumn("status", status)


def ranking(metrics: DataFrame) -> DataFrame:
    """Themes that are covered and rise, best first; ties by theme_id. One row a theme goes through one task."""
    w = Window.orderBy(F.col("weighted_return").desc(), "theme_id")
    return metrics.where("status = 'SUFFICIENT' and weighted_return > 0").withColumn("rank", F.row_number().over(w).cast("long"))


def intensity(ranked: DataFrame) -> DataFrame:
    """Adds intensity: returns scaled to 0.18 to 1; if all are equal, their share of 0.05, 1 at most."""
    every = Window.partitionBy()
    lo, hi = F.min("weighted_return").over(every), F.max("weighted_return").over(every)
    return ranked.withColumn("intensity", F.when(hi == lo, F.least(F.abs("weighted_return") / 0.05, F.lit(1.0))).otherwise(0.18 + 0.82 * F.try_divide(F.col("weighted_return") - lo, hi - lo)))


def leaders(members: DataFrame, returns: DataFrame, limit: int = 3) -> DataFrame:
    w = Window.partitionBy("theme_id").orderBy(F.col("ret").desc(), "stock_id")
    return members.join(returns.where("ret is not null"), "stock_id").withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= limit).select("theme_id", "stock_id", "ret", "place")
