"""Research questions over dated catalysts and the stocks, companies and themes that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the similarity score: same primary, overlap of types, same certainty, overlap of leaders; and the least score.
SAME_PRIMARY, SHARED_TYPES, SAME_CERTAINTY, SHARED_LEADERS, LEAST_SCORE = 0.45, 0.25, 0.05, 0.10, 0.35
#: Groups with fewer observations are left out.
LEAST_OBSERVED = 5


def shares(rows: DataFrame, by: str) -> DataFrame:
    """by, n, share (percent of all rows). The window holds one row a value."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.try_divide(100 * F.col("n"), F.sum("n").over(Window.partitionBy())))


def at_fraction(rows: DataFrame, key: list[str], value: str, names: dict[str, float], buckets: int = 1024) -> DataFrame:
    """Per key the value at position floor(f * n) of its sorted values, the last at most, for each name's f; n counts them. Values are finite.

    No task sorts a key's values: they are counted in buckets between the key's least and greatest, running counts over the buckets say in
    which one each position lies, and only these buckets' values are put in order."""
    v = rows.where(F.col(value).isNotNull()).select(F.struct(*key).alias("k"), F.col(value).alias("v"))
    reach = v.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))).otherwise(0)
    v = v.join(reach, "k").select("k", "v", part.cast("int").alias("bucket"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = v.groupBy("k", "bucket").agg(F.count("*").alias("c")).withColumn("before", before).join(reach.select("k", "n"), "k")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * f), F.col("n") - 1).alias("at")) for name, f in names.items()]))
    picks = c.select("k", "bucket", "before", "c", "n", wanted.alias("w")).where((F.col("w.at") >= F.col("before")) & (F.col("w.at") < F.col("before") + F.col("c")))
    near = v.join(picks.select("k", "bucket", "n", F.col("w.name").alias("name"), (F.col("w.at") - F.col("before") + 1).alias("nth")), ["k", "bucket"])
    found = near.withColumn("i", F.row_number().over(Window.partitionBy("k", "name").orderBy("v"))).where("i = nth")
    return found.groupBy("k").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in names]).select("k.*", "n", *names)


def cooccurrence(mentions: DataFrame, item: str, who: str, subject: Column) -> DataFrame:
    """Who else stands in the items that name the subject, and in how many. Only the subject's items are joined: no pairs are made."""
    own = mentions.where(F.col(who) == subject).select(item).distinct()
    return mentions.where(F.col(who) != subject).join(own, item, "left_semi").groupBy(who).agg(F.countDistinct(item).alias("n"))


def one_fact_each(facts: DataFrame, item: str, who: str, value: str) -> DataFrame:
    """Per who: the sum of values, with the largest fact of each item alone."""
    return facts.groupBy(who, item).agg(F.max(value).alias("most")).groupBy(who).agg(F.count("most").alias("facts"), F.sum("most").alias("total"))


def rank_changes(ranks: DataFrame, at: str, key: str, back: str) -> DataFrame:
    """ranks: at, key, rank. Adds change: rank in the latest publication at or before `at` less `back`, minus this one;
    null if there is none or the key isn't in it. The calendar holds one row a publication."""
    seconds = F.unix_seconds(F.col(at).cast("timestamp"))
    upto = Window.orderBy("second").rangeBetween(Window.unboundedPreceding, -int(back))
    calendar = ranks.select(F.col(at).alias("now"), seconds.alias("second")).distinct().withColumn("then", F.max("now").over(upto)).select("now", "then")
    old = ranks.select(F.col(at).alias("then"), F.col(key), F.col("rank").alias("old"))
    return ranks.join(calendar, F.col(at) == F.col("now")).join(old, ["then", key], "left").withColumn("change", F.col("old") - F.col("rank")).drop("now", "then", "old")


def similar_cases(cases: DataFrame, limit: int = 10) -> DataFrame:
    """cases: id, day, primary, types, certainty, leaders. The earlier cases most like the latest one (greatest day, then id):
    cases that share no type, or score too little, are left out; ties to the later day, then the smaller id."""
    today = cases.orderBy(F.desc("day"), F.desc("id")).limit(1).select(*[F.col(c).alias(f"t_{c}") for c in cases.columns])
    both = cases.join(F.broadcast(today), F.col("day") < F.col("t_day"))  # the latest case: one row
    same = F.size(F.array_intersect("types", "t_types"))
    score = (
        F.when(F.col("primary") == F.col("t_primary"), SAME_PRIMARY).otherwise(0.0)
        + SHARED_TYPES * F.try_divide(same, F.size(F.array_union("types", "t_types")))
        + F.when(F.col("certainty") == F.col("t_certainty"), SAME_CERTAINTY).otherwise(0.0)
        + F.coalesce(SHARED_LEADERS * F.try_divide(F.size(F.array_intersect("leaders", "t_leaders")), F.size("t_leaders")), F.lit(0.0))
    )
    return both.where(same > 0).select("id", "day", F.round(score, 6).alias("score")).where(F.col("score") >= LEAST_SCORE).orderBy(F.desc("score"), F.desc("day"), "id").limit(limit)


def direction(value: str) -> Column:
    """Of a group: UP, DOWN, MIXED, or UNKNOWN without any value."""
    up, down = F.count_if(F.col(value) >= 0), F.count_if(F.col(value) < 0)
    return F.when((up == 0) & (down == 0), "UNKNOWN").when(down == 0, "UP").when(up == 0, "DOWN").otherwise("MIXED")
