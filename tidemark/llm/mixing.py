"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Each source's documents, in an order shuffled by a hash, form one stream of words, which repeats and is cut
into blocks of equal size. Slot n of the mix takes the point frac(n * golden ratio); the cumulative targets map the point to a
source, and the slot's rank among its source's slots names the block it takes. The point set has low discrepancy, so every
stretch of the mix holds the sources in their proportions. Slots beyond a source's target stay empty; what a
source still lacks at the end (a few blocks) follows in slots of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCK = 512
#: 2^32 divided by the golden ratio, rounded to odd: multiples of it modulo 2^32 are the points.
_GOLDEN = 2654435769
_CELL = 20
_CHUNK = 4096


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """sizes: source, source_size. Adds sid (rank by code point, null last), weight, target, quota (whole
    words) and the ends lo, hi of its part of the points 0 to 2^32.

    The shares of the total are by weight; a target stops at limit * source_size, and the excess is dealt
    out by weight until none is above. One row a source: what runs in one task here is the list of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") - 1) % len(weights) + 1))
    w = w.withColumn("most", F.col("source_size") * F.lit(float(limit))).withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumn("total", F.sum("source_size").over(every) * share).withColumn("weights", F.sum("weight").over(every))
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # sources in order of limit / weight: those full before the common level is reached stop there
    w = w.withColumn("full", F.col("ratio") <= level)
    rest = (F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)) / F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    w = w.withColumn("rest", F.when(~F.col("full"), rest))
    w = w.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("rest")))
    w = w.withColumn("quota", F.floor(F.col("target") + 0.5))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("hi", F.floor(F.try_divide(F.sum("target").over(upto), F.sum("target").over(every)) * 4294967296.0)).withColumn("hi", F.coalesce("hi", F.lit(0)))
    w = w.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0)))
    return w.select("source", "source_size", "sid", "weight", "target", "quota", "lo", "hi")


def schedule(aims: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot (from 1), sid, rank (from 0), words: slot by slot, the block of each source's stream to take and how many words of it.

    Slots whose source has reached its target stay empty. What a source still lacks after the points (a few blocks: the
    discrepancy of the points) follows at the end, so that small sources come as near their targets as large ones.
    """
    spark = aims.sparkSession
    slots = int(aims.agg(F.coalesce(F.sum(F.ceil(F.col("quota") / block)), F.lit(0))).first()[0])
    point = F.pmod(F.pmod(F.col("slot"), F.lit(1 << 31)) * _GOLDEN, F.lit(1 << 32))
    points = spark.range(1, slots + 1).toDF("slot").withColumn("point", point).withColumn("cell", F.shiftright("point", _CELL))
    parts = aims.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", _CELL), F.shiftright(F.col("hi") - 1, _CELL))).alias("cell"))
    dealt = points.join(parts, "cell").where("point >= lo and point < hi").select("slot", "sid", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    counts = dealt.groupBy("sid", "chunk").agg(F.count("*").alias("c")).withColumn("run", F.floor(F.col("chunk") / _CHUNK))
    # ranks in three steps, of 4096 rows a key at most but for the last: slots of a chunk, chunks of a run, runs of a source
    inside = Window.partitionBy("sid", "run").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("sid", "run").agg(F.sum("c").alias("s")).withColumn("ahead", F.coalesce(F.sum("s").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sofar = counts.withColumn("base", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(runs.select("sid", "run", "ahead"), ["sid", "run"])
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot"))).join(sofar, ["sid", "chunk"]).select("slot", "sid", (F.col("ahead") + F.col("base") + F.col("r") - 1).alias("rank"))
    need = F.ceil(F.col("quota") / block)
    have = aims.join(counts.groupBy("sid").agg(F.sum("c").alias("have")), "sid", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    lacking = have.where(need > F.col("have")).select("sid", F.explode(F.sequence(F.col("have"), need - 1)).alias("rank"))
    late = lacking.select((F.row_number().over(Window.orderBy("rank", "sid")) + F.lit(slots)).cast("long").alias("slot"), "sid", "rank")
    return ranked.unionByName(late).join(aims.select("sid", "quota"), "sid").where(F.col("rank") * block < F.col("quota")).select("slot", "sid", "rank", F.least(F.lit(block), F.col("quota") - F.col("rank") * block).alias("words"))


def passes(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """Every row of docs `limit` times, once a pass over its source: doc_id, source, size, source_size, target, pass (from 0),
    place (tells rows apart), used (words the mix takes in the pass), first_slot (of these words in the mix; null if none), n_slots.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size")))
    aims = stage(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit))
    named = base.alias("b").join(aims.alias("a"), F.expr("b.source <=> a.source")).select("doc_id", "b.source", "size", "source_size", "sid", "target", "quota")
    shuffled = named.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("part", F.substring("h", 1, 3))
    ahead = Window.partitionBy("sid", "part").orderBy("h", "size")
    inside = shuffled.withColumn("n", F.row_number().over(ahead)).withColumn("before", F.coalesce(F.sum("size").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = shuffled.groupBy("sid", "part").agg(F.sum("size").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = inside.join(parts.select("sid", "part", "base"), ["sid", "part"]).withColumn("offset", F.col("base") + F.col("before"))
    every = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(limit - 1)))).withColumn("start", F.col("offset") + F.col("pass") * F.col("source_size"))
    pieces = every.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.greatest("size", F.lit(1)) - 1) / block))))
    used = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("rank") * block + F.coalesce("words", F.lit(0))) - F.greatest(F.col("start"), F.col("rank") * block))
    keys = ["sid", "part", "n", "doc_id", "source", "size", "source_size", "target", "pass"]
    met = pieces.join(schedule(aims, block), ["sid", "rank"], "left").withColumn("used", used)
    slot = F.when(F.col("used") > 0, F.col("slot"))
    found = met.groupBy(*keys).agg(F.sum("used").alias("used"), F.min(slot).alias("first_slot"), F.count(slot).alias("n_slots"))
    return found.select("doc_id", "source", "size", "source_size", "target", "pass", F.struct("sid", "part", "n").alias("place"), "used", "first_slot", "n_slots")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted; then source, first_slot
    (where the mix has its first word; null if it has none) and n_slots (of how many slots it takes words).

    Null and empty texts have size 0 and are taken 0 times. A null source is a source, last in order. Rows that
    repeat a doc_id, or have none, count each by itself. A source without words has target 0. No document is taken
    more than `limit` times its size. A text of any length is counted whole and spread over as many blocks as it fills; an
    empty table gives none. The order, and so the result, depends on doc_id and sizes only; other columns play no part.
    """
    rows = passes(docs, weights, share, limit, block).groupBy("place", "doc_id", "source", "size", "source_size", "target")
    mixed = rows.agg(F.sum("used").alias("taken"), F.min("first_slot").alias("first_slot"), F.sum("n_slots").alias("n_slots"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "n_slots")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(COALESCE(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s),
r AS (SELECT *, 2.0 * source_size / weight AS ratio, SUM(source_size) OVER () * 1.5::DOUBLE AS total, SUM(weight) OVER () AS weights FROM w),
l AS (SELECT *, ratio <= (total - COALESCE(SUM(2.0::DOUBLE * source_size) OVER p, 0)) / (weights - COALESCE(SUM(weight) OVER p, 0)) AS stops
      FROM r WINDOW p AS (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN stops THEN 2.0::DOUBLE * source_size ELSE weight * ((total - SUM(CASE WHEN stops THEN 2.0::DOUBLE * source_size ELSE 0 END) OVER ()) / SUM(CASE WHEN stops THEN 0 ELSE weight END) OVER ()) END AS target FROM l),
z AS (SELECT *, floor(target + 0.5)::BIGINT AS quota, COALESCE(floor(SUM(target) OVER (ORDER BY sid) / nullif(SUM(target) OVER (), 0) * 4294967296.0), 0)::BIGINT AS hi FROM t),
q AS (SELECT *, COALESCE(lag(hi) OVER (ORDER BY sid), 0) AS lo, ceil(quota / 512)::BIGINT AS need FROM z),
n AS (SELECT COALESCE(SUM(need), 0)::BIGINT AS slots FROM q),
p AS (SELECT slot, ((slot % 2147483648) * 2654435769) % 4294967296 AS point FROM (SELECT unnest(range(1, slots + 1)) AS slot FROM n)),
g AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM p JOIN q ON point >= lo AND point < hi),
h AS (SELECT sid, need, (SELECT count(*) FROM g WHERE g.sid = q.sid) AS have FROM q),
m AS (SELECT sid, unnest(range(have, need)) AS rank FROM h WHERE need > have),
c AS (SELECT slot, sid, rank FROM g UNION ALL SELECT (SELECT slots FROM n) + row_number() OVER (ORDER BY rank, sid), sid, rank FROM m),
b AS (SELECT c.slot, c.sid, c.rank, least(512, quota - rank * 512) AS words FROM c JOIN q ON q.sid = c.sid WHERE rank * 512 < quota),
o AS (SELECT d.*, q.sid, q.source_size, q.target, row_number() OVER () AS place,
             COALESCE(SUM(d.size) OVER (PARTITION BY q.sid ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
e AS (SELECT *, off AS start FROM o UNION ALL SELECT *, off + source_size FROM o),
x AS (SELECT *, unnest(range(start // 512, (start + greatest(size, 1) - 1) // 512 + 1)) AS rank FROM e),
u AS (SELECT x.*, b.slot, greatest(0, least(start + size, x.rank * 512 + COALESCE(b.words, 0)) - greatest(start, x.rank * 512)) AS used FROM x LEFT JOIN b ON b.sid = x.sid AND b.rank = x.rank)
SELECT doc_id, size, source_size, target, SUM(used)::BIGINT AS taken, source, MIN(slot) FILTER (used > 0)::BIGINT AS first_slot, COUNT(slot) FILTER (used > 0)::BIGINT AS n_slots
FROM u GROUP BY place, doc_id, source, size, source_size, target
"""
