"""Research queries: orders as catalysts, their lines as mentions of stocks, suppliers as companies, brands as themes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, research, timeseries
from ..sources.tables import daily_prices, members, table
from .queries import _DAILY, _MEMBERS, query, r6

_MOVES = f"{_DAILY}, moves AS (SELECT stock_id, day, (close / lag(close) OVER (PARTITION BY stock_id ORDER BY day) - 1) * 100 AS ret FROM daily)"
_BASKET = f"""{_DAILY}, {_MEMBERS}, c AS (SELECT day, lag(day) OVER (ORDER BY day) AS previous_day FROM (SELECT DISTINCT day FROM daily)),
b AS (SELECT theme_id, n.day, avg(n.close / p.close * 100 - 100) AS ret FROM daily n JOIN c USING (day) JOIN daily p ON p.stock_id = n.stock_id AND p.day = c.previous_day JOIN members m ON m.stock_id = n.stock_id GROUP BY 1, 2)"""


def _moves(spark, d):
    w = Window.partitionBy("stock_id").orderBy("day")
    return daily_prices(spark, d).select("stock_id", "day", ((F.try_divide(F.col("close"), F.lag("close").over(w)) - 1) * 100).alias("ret"))


@query("SELECT year(o_orderdate)::BIGINT AS year, count(DISTINCT o_orderkey) AS catalysts, count(DISTINCT o_custkey) AS companies, count(l_linenumber) AS records FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def q_catalyst_frequency(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("records"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.countDistinct("o_orderkey").alias("catalysts"), F.countDistinct("o_custkey").alias("companies"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))


@query("SELECT o_orderpriority AS certainty, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS share FROM orders GROUP BY 1")
def q_catalyst_certainty(spark, d):
    return research.shares(table(spark, d, "orders").select(F.col("o_orderpriority").alias("certainty")), "certainty").withColumn("share", F.round("share", 4))


@query("SELECT o_orderstatus AS novelty, count(*) AS n, min(o_orderdate::DATE) AS first_day, max(o_orderdate::DATE) AS last_day FROM orders GROUP BY 1")
def q_catalyst_continuation(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("novelty")).agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query(f"WITH {_MOVES} SELECT stock_id, place, day, round(ret, 6) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY ret DESC, day DESC) AS place FROM moves WHERE ret >= 0) WHERE place <= 3")
def q_stock_top_moves(spark, d):
    w = Window.partitionBy("stock_id").orderBy(F.desc("ret"), F.desc("day"))
    return _moves(spark, d).where("ret >= 0").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").withColumn("ret", r6("ret"))


@query("WITH s AS (SELECT min(l_suppkey) AS subject FROM lineitem), own AS (SELECT DISTINCT l_orderkey FROM lineitem, s WHERE l_suppkey = subject) SELECT l_suppkey AS company, count(DISTINCT l_orderkey) AS n FROM lineitem, s WHERE l_suppkey <> subject AND l_orderkey IN (FROM own) GROUP BY 1")
def q_stock_cooccurrence(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("company"))
    subject = l.agg(F.min("company").alias("subject"))
    return research.cooccurrence(l.crossJoin(F.broadcast(subject)), "l_orderkey", "company", F.col("subject"))


@query(f"WITH {_BASKET}, k AS (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY ret) AS i, count(*) OVER (PARTITION BY theme_id) AS n FROM b) SELECT theme_id, max(n) AS days, round(sum(ret), 4) AS total, round(max(CASE WHEN i = n // 2 + 1 THEN ret END), 6) AS upper_median, arg_max(day, (ret, day)) AS best_day, arg_min(day, (ret, day)) AS worst_day FROM k GROUP BY 1")
def q_theme_comparison(spark, d):
    p = daily_prices(spark, d)
    b = timeseries.basket_returns(members(spark, d), p, asof.previous_days(p)).where("basket_return is not null")
    middle = research.at_fraction(b, ["theme_id"], "basket_return", {"upper_median": 0.5}).drop("n")
    at = F.struct("basket_return", "day")
    a = b.groupBy("theme_id").agg(F.count("*").alias("days"), F.round(F.sum("basket_return"), 4).alias("total"), F.max_by("day", at).alias("best_day"), F.min_by("day", at).alias("worst_day"))
    return a.join(middle, "theme_id").withColumn("upper_median", r6("upper_median"))


@query("SELECT p_brand AS theme_id, count(DISTINCT l_orderkey) AS catalysts FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def q_theme_frequency(spark, d):
    day = F.col("l_shipdate")
    l = table(spark, d, "lineitem").where((day >= F.lit("1997-01-01").cast("timestamp_ntz")) & (day < F.lit("1998-01-01").cast("timestamp_ntz")))
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("theme_id"))
    return l.join(p, F.col("p_partkey") == F.col("l_partkey")).groupBy("theme_id").agg(F.countDistinct("l_orderkey").alias("catalysts"))


@query("SELECT p_brand AS theme_id, sum(coalesce(nullif(n, 0), 1))::BIGINT AS reactions FROM (SELECT l_orderkey, p_brand, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) GROUP BY 1")
def q_catalyst_theme_reaction(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("theme_id"))
    n = table(spark, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey", "theme_id").agg(F.count_if(F.col("l_returnflag") == "R").alias("n"))
    return n.groupBy("theme_id").agg(F.sum(F.coalesce(F.nullif("n", F.lit(0)), F.lit(1))).alias("reactions"))


@query("SELECT l_suppkey AS company, count(DISTINCT l_orderkey) AS all_catalysts, count(DISTINCT l_orderkey) FILTER (l_returnflag IN ('A', 'R')) AS direct FROM lineitem GROUP BY 1")
def q_company_direct_event(spark, d):
    one = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("company"), "l_orderkey").agg(F.bool_or(F.col("l_returnflag").isin("A", "R")).alias("is_direct"))
    return one.groupBy("company").agg(F.count("*").alias("all_catalysts"), F.count_if("is_direct").alias("direct"))


@query("SELECT l_suppkey AS company, count(*) AS facts, round(sum(most), 2) AS total FROM (SELECT l_suppkey, l_orderkey, max(l_extendedprice) AS most FROM lineitem WHERE l_extendedprice >= 1000 GROUP BY 1, 2) GROUP BY 1")
def q_company_value_summary(spark, d):
    l = table(spark, d, "lineitem").where("l_extendedprice >= 1000").withColumn("company", F.col("l_suppkey"))
    return research.one_fact_each(l, "l_orderkey", "company", "l_extendedprice").withColumn("total", F.round("total", 2))


@query(f"WITH {_DAILY}, f AS (SELECT stock_id, unnest([1, 5, 20])::BIGINT AS horizon, unnest([" + ", ".join(f"lead(close, {h}) OVER w / close * 100 - 100" for h in (1, 5, 20)) + "]) AS ret FROM daily WINDOW w AS (PARTITION BY stock_id ORDER BY day)) SELECT p_brand AS theme_id, horizon, count(*) AS eligible, count(ret) AS observed, count(*) FILTER (ret > 0) AS positive, round(median(ret), 6) AS median FROM f JOIN part ON p_partkey = stock_id GROUP BY 1, 2")
def outcome_summary(spark, d):
    f = timeseries.forward_returns(daily_prices(spark, d))
    each = f.select("stock_id", F.explode(F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"fwd_{h}").alias("ret")) for h in (1, 5, 20)])).alias("o")).select("stock_id", "o.*")
    themed = each.join(members(spark, d).select("stock_id", "theme_id"), "stock_id")
    return themed.groupBy("theme_id", "horizon").agg(F.count("*").alias("eligible"), F.count("ret").alias("observed"), F.count_if(F.col("ret") > 0).alias("positive"), r6(F.median("ret")).alias("median"))


@query(f"WITH {_MOVES}, k AS (SELECT p_type, ret, row_number() OVER (PARTITION BY p_type ORDER BY ret) AS i, count(*) OVER (PARTITION BY p_type) AS n FROM moves JOIN part ON p_partkey = stock_id WHERE ret IS NOT NULL) SELECT p_type AS type, max(n) AS observed, round(median(ret), 6) AS median, round(max(CASE WHEN i = least(floor(0.25::DOUBLE * n), n - 1) + 1 THEN ret END), 6) AS p25 FROM k GROUP BY 1 HAVING max(n) >= 5")
def catalyst_groups(spark, d):
    typed = _moves(spark, d).where("ret is not null").join(table(spark, d, "part").select("p_partkey", F.col("p_type").alias("type")), F.col("p_partkey") == F.col("stock_id"))
    p25 = research.at_fraction(typed, ["type"], "ret", {"p25": 0.25}).where(F.col("n") >= research.LEAST_OBSERVED)
    return typed.groupBy("type").agg(r6(F.median("ret")).alias("median")).join(p25, "type").select("type", F.col("n").alias("observed"), "median", r6("p25").alias("p25"))


_TYPES, _LEADERS = "list_distinct(list(l_returnflag))", "list_distinct(list(p_brand))"


@query(f"""WITH x AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_orderstatus AS "primary", o_orderpriority AS certainty, {_TYPES} AS types, {_LEADERS} AS leaders FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
t AS (SELECT * FROM x ORDER BY day DESC, id DESC LIMIT 1),
s AS (SELECT x.id, x.day, round(CASE WHEN x."primary" = t."primary" THEN 0.45 ELSE 0 END::DOUBLE + 0.25::DOUBLE * len(list_intersect(x.types, t.types)) / len(list_distinct(x.types || t.types)) + CASE WHEN x.certainty = t.certainty THEN 0.05 ELSE 0 END::DOUBLE + 0.10::DOUBLE * len(list_intersect(x.leaders, t.leaders)) / len(t.leaders), 6) AS score
FROM x, t WHERE x.day < t.day AND len(list_intersect(x.types, t.types)) > 0)
SELECT * FROM s WHERE score >= 0.35 ORDER BY score DESC, day DESC, id LIMIT 10""")
def similar_events(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    named = l.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("types"), F.collect_set("p_brand").alias("leaders"))
    o = table(spark, d, "orders").join(named, F.col("o_orderkey") == F.col("l_orderkey"))
    return research.similar_cases(o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("primary"), "types", F.col("o_orderpriority").alias("certainty"), "leaders"))


@query("WITH v AS (SELECT date_trunc('hour', ts) AS hour, event_type, round(sum(value), 4) AS total FROM events GROUP BY 1, 2), r AS (SELECT hour, event_type, row_number() OVER (PARTITION BY hour ORDER BY total DESC, event_type) AS rank FROM v), c AS (SELECT hour, max(hour) OVER (ORDER BY hour RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 6 HOUR PRECEDING) AS before FROM (SELECT DISTINCT hour FROM r)) SELECT r.hour, r.event_type, r.rank, o.rank - r.rank AS change FROM r JOIN c USING (hour) LEFT JOIN r o ON o.hour = c.before AND o.event_type = r.event_type")
def rank_change(spark, d):
    v = table(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.round(F.sum("value"), 4).alias("total"))
    r = v.select("hour", "event_type", F.row_number().over(Window.partitionBy("hour").orderBy(F.desc("total"), "event_type")).cast("long").alias("rank"))
    return research.rank_changes(r, "hour", "event_type", 6 * 3600).select("hour", "event_type", "rank", "change")


@query(f"WITH {_MOVES} SELECT p_brand AS theme_id, day, count(ret) AS n, CASE WHEN count(ret) = 0 THEN 'UNKNOWN' WHEN count(*) FILTER (ret < 0) = 0 THEN 'UP' WHEN count(*) FILTER (ret >= 0) = 0 THEN 'DOWN' ELSE 'MIXED' END AS direction FROM moves JOIN part ON p_partkey = stock_id GROUP BY 1, 2")
def section_direction(spark, d):
    m = _moves(spark, d).join(members(spark, d).select("stock_id", "theme_id"), "stock_id")
    return m.groupBy("theme_id", "day").agg(F.count("ret").alias("n"), research.direction("ret").alias("direction"))
