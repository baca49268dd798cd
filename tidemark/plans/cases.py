"""Similar cases: orders as cases, with their lines' flags as types and their parts' brands as leaders; daily prices for outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases as C
from ..sources.tables import daily_prices, table
from .queries import _DAILY, query, r6

# the first three lines' brands are leaders; of every 17th order all brands are
_CASES = """ln AS (SELECT l_orderkey, l_linenumber, l_returnflag AS type, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
ty AS (SELECT l_orderkey, list(type ORDER BY f, type) AS types FROM (SELECT l_orderkey, type, min(l_linenumber) AS f FROM ln WHERE l_linenumber <= 4 GROUP BY 1, 2) GROUP BY 1),
le AS (SELECT l_orderkey, list(DISTINCT p_brand) AS leaders FROM ln WHERE l_linenumber <= 3 OR l_orderkey % 17 = 0 GROUP BY 1),
ca AS (SELECT o_orderkey AS id, o_custkey % 40 AS theme, o_orderdate::DATE AS day, types, CASE o_orderstatus WHEN 'O' THEN 'UP' WHEN 'F' THEN 'DOWN' ELSE 'UNKNOWN' END AS direction, CASE o_orderpriority WHEN '5-LOW' THEN 'UNSPECIFIED' WHEN '1-URGENT' THEN 'CONFIRMED' ELSE 'EXPECTED' END AS certainty, coalesce(leaders, []) AS leaders
  FROM orders JOIN ty ON ty.l_orderkey = o_orderkey LEFT JOIN le ON le.l_orderkey = o_orderkey),
sc AS (SELECT a.id, b.id AS similar_id, b.day, round(0.25::DOUBLE * (len(list_intersect(a.types, b.types)) / len(list_distinct(a.types || b.types))) + CASE WHEN a.types[1] = b.types[1] THEN 0.45 ELSE 0 END::DOUBLE + CASE WHEN a.direction = b.direction AND a.direction <> 'UNKNOWN' THEN 0.15 ELSE 0 END::DOUBLE
  + CASE WHEN a.certainty = b.certainty AND a.certainty <> 'UNSPECIFIED' THEN 0.05 ELSE 0 END::DOUBLE + 0.10::DOUBLE * coalesce(len(list_intersect(a.leaders, b.leaders)) / nullif(len(a.leaders), 0), 0), 9) AS score FROM ca a JOIN ca b ON a.theme = b.theme AND b.day < a.day AND list_has_any(a.types, b.types)),
pl AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, day DESC, similar_id) AS place, count(*) OVER (PARTITION BY id) AS n FROM sc WHERE score >= 0.35),
sim AS (SELECT id, place, similar_id, score, n > 20 AS has_more FROM pl WHERE place <= 20)"""
# an event's base is the stock's last price at or before its day; parts of even lines are a case's members, those of every 9th order are unknown
_RETURNS = f"""{_DAILY}, pr AS (SELECT stock_id, day, CASE WHEN (stock_id + day('2000-01-01'::DATE) + date_diff('day', DATE '1995-01-01', day)) % 50 = 0 THEN NULL ELSE close END AS close FROM daily),
fw AS (SELECT *, lead(close, 1) OVER w AS a1, lead(close, 5) OVER w AS a5, lead(close, 20) OVER w AS a20 FROM pr WINDOW w AS (PARTITION BY stock_id ORDER BY day)),
mem AS (SELECT l_orderkey AS id, l_linenumber, l_partkey AS stock_id, o_orderdate::DATE AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ret AS (SELECT mem.*, CASE WHEN mem.day >= (SELECT min(day) FROM pr) THEN fw.day END AS base_day, CASE WHEN mem.day >= (SELECT min(day) FROM pr) THEN nullif(fw.close, 0) END AS base_close, a1, a5, a20, fw.stock_id IS NOT NULL AS seen FROM mem ASOF LEFT JOIN fw ON mem.stock_id = fw.stock_id AND mem.day >= fw.day),
out AS (SELECT id, l_linenumber, stock_id, day, base_day, base_close, (a1 / base_close - 1) * 100 AS fwd_1, (a5 / base_close - 1) * 100 AS fwd_5, (a20 / base_close - 1) * 100 AS fwd_20, seen FROM ret),
mis AS (SELECT *, CASE WHEN day < (SELECT min(day) FROM pr) THEN 'BEFORE_CORPUS_RANGE' WHEN NOT seen THEN 'NO_PRICE_ON_OR_BEFORE_EVENT' WHEN base_close IS NULL THEN 'BASE_CLOSE_MISSING' WHEN fwd_1 IS NULL OR fwd_5 IS NULL OR fwd_20 IS NULL THEN 'HORIZON_NOT_REACHED' END AS missing FROM out)"""
_OUTCOMES = f"""{_RETURNS}, cm AS (SELECT id, count(*) FILTER (known) AS n, count(base_close) FILTER (known) AS priced, avg(fwd_1) FILTER (known) AS h1, avg(fwd_5) FILTER (known) AS h5, avg(fwd_20) FILTER (known) AS h20 FROM (SELECT *, l_linenumber % 2 = 0 AND id % 9 <> 0 AS known FROM mis) GROUP BY 1),
oc AS (SELECT id, h::BIGINT AS horizon, CASE h WHEN 1 THEN h1 WHEN 5 THEN h5 ELSE h20 END / 100 AS outcome, CASE WHEN n = 0 THEN 'NO_HISTORICAL_MEMBERS' WHEN priced = 0 THEN 'NO_PRICE_ON_OR_BEFORE_EVENT' END AS reason FROM cm, (VALUES (1), (5), (20)) hs(h))"""


def _cases(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_returnflag").alias("type")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    # one grouping for both: types in the order of their first lines
    types = F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") <= 4, F.struct("l_linenumber", "type")))).getField("type"))
    leaders = F.collect_set(F.when(F.expr("l_linenumber <= 3 or l_orderkey % 17 = 0"), F.col("p_brand")))
    lines = l.groupBy("l_orderkey").agg(types.alias("types"), leaders.alias("leaders"))
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey").join(lines, "l_orderkey")
    direction = F.when(F.col("o_orderstatus") == "O", "UP").when(F.col("o_orderstatus") == "F", "DOWN").otherwise("UNKNOWN")
    certainty = F.when(F.col("o_orderpriority") == "5-LOW", "UNSPECIFIED").when(F.col("o_orderpriority") == "1-URGENT", "CONFIRMED").otherwise("EXPECTED")
    return o.select(F.col("l_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("theme"), F.to_date("o_orderdate").alias("day"), "types", direction.alias("direction"), certainty.alias("certainty"), "leaders")


def _prices(spark, d):
    gap = (F.col("stock_id") + 1 + F.date_diff("day", F.lit("1995-01-01").cast("date"))) % 50 == 0
    return daily_prices(spark, d).select("stock_id", "day", F.when(~gap, F.col("close")).alias("close"))


def _members(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_partkey").alias("stock_id")).join(o, "id")


@query(f"WITH {_CASES} SELECT id, place, similar_id, round(score, 6) AS score, has_more FROM sim")
def similar_cases_of_all(spark, d):
    """The 20 earlier cases of its theme most like each case, and whether there are more."""
    return C.similar_cases(_cases(spark, d)).withColumn("score", r6("score"))


@query(f"WITH {_RETURNS} SELECT id, l_linenumber, stock_id, base_day, round(base_close, 6) AS base_close, " + ", ".join(f"round(fwd_{h}, 6) AS fwd_{h}" for h in C.HORIZONS) + ", missing FROM mis")
def returns_from_event(spark, d):
    """Returns of every order's parts from the last price at or before the order's day."""
    r = C.event_returns(_members(spark, d), _prices(spark, d))
    return r.select("id", "l_linenumber", "stock_id", "base_day", r6("base_close").alias("base_close"), *[r6(f"fwd_{h}").alias(f"fwd_{h}") for h in C.HORIZONS], "missing")


@query(f"WITH {_CASES}, {_OUTCOMES} SELECT sim.id, horizon, count(*) AS eligible, count(outcome) AS observed, count(*) FILTER (round(outcome, 6) > 0) AS positive, round(2 * median(round(outcome, 6)), 6) / 2 AS median FROM sim JOIN oc ON oc.id = sim.similar_id GROUP BY 1, 2")
def similar_case_outcomes(spark, d):
    """What became of the cases most like each case: by horizon how many, how many observed, how many rose, and the median."""
    m = _members(spark, d)
    known = m.select("id", F.when((F.col("l_linenumber") % 2 == 0) & (F.col("id") % 9 != 0), F.col("stock_id")).alias("stock_id"), "day")
    return C.similar_outcomes(_cases(spark, d), C.case_means(known, _prices(spark, d))).withColumn("median", r6(2 * F.col("median")) / 2)  # means of two 6-place numbers: exact at twice their size
