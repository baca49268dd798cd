"""Connected components of an undirected link table, by least label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_sorting, stage


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns v, component (least id reachable) for each id that has a link.

    Each round takes the least label among the neighbours, then the label's own label, so that chains
    shorten by doubling. Rounds end when nothing changes; every round is written out.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("component")))
    while True:
        near = both.join(by_sorting(labels), both["b"] == labels["v"]).groupBy("a").agg(F.min("component").alias("near"))
        met = labels.join(by_sorting(near), labels["v"] == near["a"], "left").select("v", "component", F.least("component", "near").alias("to"))
        jump = labels.select(F.col("v").alias("to"), F.col("component").alias("far"))
        new = stage(met.join(by_sorting(jump), "to", "left").select("v", "component", F.least("to", F.coalesce("far", "to")).alias("to")))
        labels = new.select("v", F.col("to").alias("component"))
        if new.where("to <> component").limit(1).count() == 0:
            return labels
