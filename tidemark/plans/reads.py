"""Relational reads, remaining questions, writes and their checks: orders as catalysts, lines as relations, suppliers as companies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import timeseries, writes
from ..sources.tables import daily_prices, table
from .queries import _DAILY, query, r6
from .research import _MOVES, _moves


@query("WITH x AS (SELECT l_partkey, l_shipdate::DATE AS day, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_suppkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' AND p_size > 5) SELECT l_orderkey, l_linenumber, l_partkey, day FROM x WHERE n = 1")
def daily_rows(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").join(table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.col("l_extendedprice").desc(), "l_suppkey")
    return l.withColumn("n", F.row_number().over(w)).where("n = 1").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("day"))


@query("WITH q AS (SELECT DISTINCT o_orderdate::DATE AS asked FROM orders), t AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem WHERE l_quantity = 50 AND l_tax = 0) SELECT asked, max(day) AS day FROM q LEFT JOIN t ON day <= asked GROUP BY 1")
def latest_date_fallback(spark, d):
    """The latest day with rows at or before the one asked for: one ordered pass over both calendars."""
    q = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("asked")).distinct().withColumn("day", F.lit(None).cast("date"))
    t = table(spark, d, "lineitem").where("l_quantity = 50 and l_tax = 0").select(F.to_date("l_shipdate").alias("day")).distinct()
    both = q.withColumn("is_asked", F.lit(True)).unionByName(t.select(F.col("day").alias("asked"), "day", F.lit(False).alias("is_asked")))
    w = Window.orderBy("asked", "is_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("day", F.max("day").over(w)).where("is_asked").select("asked", "day")


@query("SELECT o_orderdate::DATE AS day, count(DISTINCT o_orderkey) AS unsplit FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 1) GROUP BY 1")
def unsplit_posts(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.countDistinct("o_orderkey").alias("unsplit"))


@query("WITH s AS (SELECT l_orderkey, l_returnflag AS section, p_brand AS theme, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS stocks, min(l_linenumber) AS first_line FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3), t AS (SELECT l_orderkey, section, string_agg(theme || ':' || stocks, ';' ORDER BY first_line, theme) AS themes, min(first_line) AS first_line FROM s GROUP BY 1, 2) SELECT l_orderkey, string_agg(section || '[' || themes || ']', ' ' ORDER BY first_line, section) AS tree FROM t GROUP BY 1")
def nested_sections(spark, d):
    """Sections, their themes and their stocks of a post, each in the order of the source."""
    l = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("theme")), "l_partkey")
    joined = lambda c, order, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, c.alias("x")))), lambda y: y["x"]), sep)
    s = l.groupBy("l_orderkey", F.col("l_returnflag").alias("section"), "theme").agg(joined(F.col("l_partkey").cast("string"), ["l_linenumber", "l_partkey"], ",").alias("stocks"), F.min("l_linenumber").alias("first_line"))
    t = s.groupBy("l_orderkey", "section").agg(joined(F.concat("theme", F.lit(":"), "stocks"), ["first_line", "theme"], ";").alias("themes"), F.min("first_line").alias("first_line"))
    return t.groupBy("l_orderkey").agg(joined(F.concat("section", F.lit("["), "themes", F.lit("]")), ["first_line", "section"], " ").alias("tree"))


@query("SELECT s_suppkey, count(DISTINCT l_partkey) AS instruments, min(l_partkey) AS first_code FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def company_codes(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey")
    return l.join(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", "left_semi").groupBy("s_suppkey").agg(F.countDistinct("l_partkey").alias("instruments"), F.min("l_partkey").alias("first_code"))


@query(f"WITH {_MOVES}, x AS (SELECT p_brand AS theme, day, stock_id, ret, row_number() OVER (PARTITION BY p_brand, day ORDER BY stock_id) AS n FROM moves JOIN part ON p_partkey = stock_id WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND day BETWEEN DATE '1997-03-01' AND DATE '1997-09-30') SELECT theme, day, stock_id, round(ret, 6) AS ret FROM x WHERE n = 1")
def theme_changes(spark, d):
    p = table(spark, d, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select(F.col("p_partkey").alias("stock_id"), F.col("p_brand").alias("theme"))
    m = _moves(spark, d).where("day between date '1997-03-01' and date '1997-09-30'").join(p, "stock_id")
    return m.groupBy("theme", "day").agg(F.min_by(F.struct("stock_id", "ret"), "stock_id").alias("x")).select("theme", "day", "x.stock_id", r6("x.ret").alias("ret"))


@query("WITH l AS (SELECT l_orderkey, l_returnflag, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey) AS n FROM lineitem WHERE l_linenumber > 2) SELECT o_orderkey, o_orderstatus, l_returnflag AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate NULLS LAST, o_orderkey) AS place FROM orders LEFT JOIN l ON l_orderkey = o_orderkey AND n = 1 WHERE o_totalprice > 1000")
def theme_history_labels(spark, d):
    """Records with their latest label, if any; records without a date last."""
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_shipdate").desc(), F.col("l_linenumber").desc(), "l_partkey")
    l = table(spark, d, "lineitem").where("l_linenumber > 2").withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("label"), "l_shipdate")
    o = table(spark, d, "orders").where("o_totalprice > 1000").join(l, "o_orderkey", "left")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("l_shipdate").asc_nulls_last(), "o_orderkey"))
    return o.select("o_orderkey", "o_orderstatus", "label", place.cast("long").alias("place"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = o_orderkey AND p_brand = 'Brand#7' AND s_nationkey < 20) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def catalyst_predicates(spark, d):
    l = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    path = l.join(table(spark, d, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").join(table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")
    o = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return o.join(l.where("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(path, "o_orderkey", "left_semi").join(l.where("l_quantity > 49"), "o_orderkey", "left_anti").select("o_orderkey")


_CHILD = "child AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS roles, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS themes, count(*) AS reactions FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"


@query(f"WITH {_CHILD}, latest AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_orderkey, o_custkey, coalesce(roles, '') AS roles, coalesce(themes, '') AS themes, coalesce(reactions, 0) AS reactions FROM latest LEFT JOIN child ON l_orderkey = o_orderkey WHERE n = 1")
def catalysts_with_children(spark, d):
    """Latest revisions with their children, each aggregated once before the join."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    l = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    child = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(names("l_returnflag").alias("roles"), names("p_brand").alias("themes"), F.count("*").alias("reactions"))
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    latest = table(spark, d, "orders").withColumn("n", F.row_number().over(w)).where("n = 1")
    return latest.join(child, "o_orderkey", "left").select("o_orderkey", "o_custkey", F.coalesce("roles", F.lit("")).alias("roles"), F.coalesce("themes", F.lit("")).alias("themes"), F.coalesce("reactions", F.lit(0)).alias("reactions"))


@query("WITH latest AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT s_suppkey, o_orderkey, l_linenumber, l_extendedprice AS value, rank() OVER (PARTITION BY s_suppkey ORDER BY l_extendedprice DESC) AS place FROM latest JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE n = 1 AND p_size > 10")
def value_fact_rows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    latest = table(spark, d, "orders").withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("o_orderkey").alias("l_orderkey"))
    l = table(spark, d, "lineitem").join(latest, "l_orderkey").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey").join(table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    place = F.rank().over(Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc()))
    return l.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_extendedprice").alias("value"), place.cast("long").alias("place"))


@query(f"WITH {_DAILY}, f AS (SELECT stock_id, day, lead(close, 5) OVER (PARTITION BY stock_id ORDER BY day) / close * 100 - 100 AS ret FROM daily) SELECT l_suppkey, l_orderkey, l_partkey, round(max(ret), 6) AS ret FROM lineitem JOIN f ON stock_id = l_partkey AND day = l_shipdate::DATE WHERE l_returnflag = 'A' GROUP BY 1, 2, 3")
def direct_outcomes(spark, d):
    f = timeseries.forward_returns(daily_prices(spark, d), (5,))
    l = table(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_suppkey", "l_orderkey", "l_partkey", F.col("l_partkey").alias("stock_id"), F.to_date("l_shipdate").alias("day"))
    return l.join(f, ["stock_id", "day"]).groupBy("l_suppkey", "l_orderkey", "l_partkey").agg(r6(F.max("fwd_5")).alias("ret"))


@query("WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 60), m AS (SELECT DISTINCT o_orderkey, l_partkey FROM e JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'O'), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_partkey) AS place FROM m) SELECT o_orderkey, l_partkey, place FROM r WHERE place <= 20")
def leader_outcomes(spark, d):
    """Leaders of the 60 newest events, 20 of each at most, each stock once: limits of the report."""
    e = table(spark, d, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(60).select("o_orderkey")
    m = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(F.broadcast(e), "o_orderkey").distinct()
    place = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_partkey")).cast("long")
    return m.withColumn("place", place).where("place <= 20")


@query("WITH u AS (SELECT p_partkey AS code, p_name AS name, 1 AS priority FROM part WHERE p_size > 25 UNION ALL SELECT l_partkey, 'stock ' || l_partkey, 2 FROM lineitem) SELECT code, name, priority::BIGINT AS priority FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY priority, name) AS n FROM u) WHERE n = 1")
def dictionary_with_priority(spark, d):
    a = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.lit(1).cast("long").alias("priority"))
    b = table(spark, d, "lineitem").select(F.col("l_partkey").alias("code"), F.concat(F.lit("stock "), F.col("l_partkey").cast("string")).alias("name"), F.lit(2).cast("long").alias("priority"))
    return a.unionByName(b).groupBy("code").agg(F.min(F.struct("priority", "name")).alias("x")).select("code", "x.name", "x.priority")


@query("WITH c AS (SELECT user_id, ts::DATE AS day, min(ts) AS first_ts FROM events GROUP BY 1, 2), e AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type FROM events) SELECT c.user_id, c.day, c.first_ts, (SELECT min(p.day) FROM c p WHERE p.user_id = c.user_id AND p.day < c.day) AS since, coalesce((SELECT string_agg(DISTINCT e.event_type, ',' ORDER BY e.event_type) FROM e WHERE e.user_id = c.user_id AND e.day < c.day), '') AS before FROM c")
def active_contexts(spark, d):
    """Per key and day: since when it is known, and what stood for it on earlier days. Windows over days replace the correlated subqueries."""
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("first_ts"), F.collect_set("event_type").alias("kinds"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = F.array_join(F.coalesce(F.sort_array(F.array_distinct(F.flatten(F.collect_list("kinds").over(w)))), F.array()), ",")
    return e.select("user_id", "day", "first_ts", F.min("day").over(w).alias("since"), before.alias("before"))


@query("WITH s AS (SELECT l_partkey, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS snapshot FROM lineitem GROUP BY 1) SELECT s.l_partkey AS theme_id, l.l_suppkey AS leader, count(*) AS n FROM s JOIN lineitem l ON l.l_orderkey = s.snapshot GROUP BY 1, 2")
def leader_map(spark, d):
    l = table(spark, d, "lineitem")
    s = l.groupBy(F.col("l_partkey").alias("theme_id")).agg(F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("l_orderkey"))
    return s.join(l.select("l_orderkey", F.col("l_suppkey").alias("leader")), "l_orderkey").groupBy("theme_id", "leader").agg(F.count("*").alias("n"))


@query("SELECT stock_id, theme_id, kind, count(*) AS n FROM (SELECT l_partkey AS stock_id, l_returnflag AS theme_id, 'LEADER' AS kind FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT p_partkey, p_brand, 'MEMBER' FROM part) GROUP BY 1, 2, 3")
def stored_references(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("stock_id"), F.col("l_returnflag").alias("theme_id"), F.lit("LEADER").alias("kind"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("stock_id"), F.col("p_brand").alias("theme_id"), F.lit("MEMBER").alias("kind"))
    return a.unionByName(b).groupBy("stock_id", "theme_id", "kind").agg(F.count("*").alias("n"))


@query("WITH links AS (SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 UNION ALL SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 2 UNION ALL SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 3) SELECT o_orderkey, count(k) AS links FROM orders LEFT JOIN links ON k = o_orderkey GROUP BY 1 HAVING count(k) <> 1")
def source_link_integrity(spark, d):
    """Sources that don't have exactly one link over all link tables."""
    l = table(spark, d, "lineitem")
    part = lambda flag, n: l.where((F.col("l_returnflag") == flag) & (F.col("l_linenumber") == n)).select(F.col("l_orderkey").alias("o_orderkey"))
    links = part("A", 1).unionAll(part("N", 2)).unionAll(part("R", 3)).groupBy("o_orderkey").agg(F.count("*").alias("links"))
    return table(spark, d, "orders").select("o_orderkey").join(links, "o_orderkey", "left").withColumn("links", F.coalesce("links", F.lit(0))).where("links <> 1")


@query("WITH t AS (SELECT l_shipdate::DATE AS day, l_returnflag AS section, p_brand AS theme, round(avg(l_discount - 0.05), 9) AS rate FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3) SELECT day, section, count(*) FILTER (rate >= 0) AS up, count(*) FILTER (rate < 0) AS down, coalesce(string_agg(theme, ',' ORDER BY theme) FILTER (rate >= 0.04), '') AS strong FROM t WHERE day >= DATE '1998-01-01' AND day < DATE '1998-07-01' GROUP BY 1, 2")
def q_day_movers_by_section(spark, d):
    l = table(spark, d, "lineitem").where(F.to_date("l_shipdate").between("1998-01-01", "1998-06-30")).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("theme")), "l_partkey")
    t = l.groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("section"), "theme").agg(F.round(F.avg(F.col("l_discount") - 0.05), 9).alias("rate"))  # sums of doubles depend on their order: at a bound only the rounded one is the same in any
    return t.groupBy("day", "section").agg(F.count_if(F.col("rate") >= 0).alias("up"), F.count_if(F.col("rate") < 0).alias("down"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("rate") >= 0.04, F.col("theme")))), ",").alias("strong"))


@query(f"WITH {_MOVES} SELECT m.stock_id, m.day, round(m.ret, 6) AS ret, l_orderkey AS reason FROM moves m JOIN lineitem ON l_partkey = m.stock_id AND l_shipdate::DATE = m.day")
def q_stock_day_reason(spark, d):
    """Why a stock moved on a day: the relations of that day, of every stock and day."""
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("stock_id"), F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("reason"))
    return _moves(spark, d).join(l, ["stock_id", "day"]).select("stock_id", "day", r6("ret").alias("ret"), "reason")


@query("SELECT l_partkey AS stock_id, count(DISTINCT l_returnflag) AS memberships, count(DISTINCT CASE WHEN l_discount = 0 THEN l_returnflag END) AS without_reason FROM lineitem WHERE l_shipdate >= DATE '1999-01-01' GROUP BY 1")
def q_stock_theme_membership(spark, d):
    l = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    return l.groupBy(F.col("l_partkey").alias("stock_id")).agg(F.countDistinct("l_returnflag").alias("memberships"), F.countDistinct(F.when(F.col("l_discount") == 0, F.col("l_returnflag"))).alias("without_reason"))


@query("WITH a AS (SELECT o_custkey, o_orderkey, o_totalprice, count(l_linenumber) AS evidence FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3), g AS (SELECT *, bool_and(evidence > 0) OVER (PARTITION BY o_custkey) AS answered, count(*) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM a) SELECT o_custkey, o_orderkey, place, greatest(total - 5, 0) AS cut FROM g WHERE answered AND place <= 5")
def q_gated_answers(spark, d):
    """An answer whose rows all have evidence, cut at five rows with the number cut; others are refused whole."""
    ev = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("evidence"))
    every = Window.partitionBy("o_custkey")
    g = table(spark, d, "orders").join(ev, "o_orderkey", "left").withColumn("answered", F.min(F.col("evidence").isNotNull()).over(every)).withColumn("total", F.count("*").over(every))
    g = g.withColumn("place", F.row_number().over(every.orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long"))
    return g.where("answered and place <= 5").select("o_custkey", "o_orderkey", "place", F.greatest(F.col("total") - 5, F.lit(0)).alias("cut"))


_SCD = "c AS (SELECT p_partkey AS k, p_brand AS brand, p_size AS size, DATE '2024-01-01' AS valid_from, 1 + p_partkey % 3 AS revision FROM part WHERE p_size <> 7), i AS (SELECT p_partkey AS k, p_brand AS brand, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part WHERE p_size <> 13), j AS (SELECT coalesce(c.k, i.k) AS k, c.k IS NULL AS fresh, i.k IS NULL AS gone, c.brand = i.brand AND c.size = i.size AS same, c.brand AS b0, c.size AS s0, i.brand AS b1, i.size AS s1, valid_from, revision FROM c FULL JOIN i ON c.k = i.k)"


@query(f"WITH {_SCD} SELECT k, b1 AS brand, s1 AS size, DATE '2024-02-01' AS valid_from, NULL::DATE AS valid_to, 1::BIGINT AS revision, 'OPENED' AS action FROM j WHERE fresh UNION ALL SELECT k, b0, s0, valid_from, CASE WHEN same THEN NULL ELSE DATE '2024-02-01' END, revision, CASE WHEN same THEN 'TOUCHED' ELSE 'CLOSED' END FROM j WHERE NOT fresh UNION ALL SELECT k, b1, s1, DATE '2024-02-01', NULL, revision + 1, 'OPENED' FROM j WHERE NOT fresh AND NOT gone AND NOT same")
def scd2_history(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    c = p.where("p_size <> 7").select(k.alias("k"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.lit("2024-01-01").cast("date").alias("valid_from"), (1 + k % 3).alias("revision"))
    i = p.where("p_size <> 13").select(k.alias("k"), F.col("p_brand").alias("brand"), F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"))
    return writes.scd2(c, i, ["k"], ["brand", "size"], "2024-02-01")


@query("SELECT o_orderkey, 'NOT_VISIBLE' AS status FROM orders WHERE o_orderdate >= DATE '1999-01-01' AND o_orderdate < DATE '1999-07-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def missing_posts(spark, d):
    """Posts of the window that the newest listing doesn't hold."""
    o = table(spark, d, "orders").where(F.to_date("o_orderdate").between("1999-01-01", "1999-06-30"))
    listed = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(listed, "o_orderkey", "left_anti").select("o_orderkey", F.lit("NOT_VISIBLE").alias("status"))


@query("WITH h AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_totalprice < 150000), i AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_totalprice > 80000) SELECT i.k AS k, CASE WHEN h.k IS NULL THEN 'INSERT' WHEN h.v IS NOT DISTINCT FROM i.v THEN 'SKIP' ELSE 'CONFLICT' END AS action FROM i LEFT JOIN h ON h.k = i.k")
def label_load(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    h = o.where("o_totalprice < 150000").select(k.alias("k"), F.col("o_orderstatus").alias("v"))
    i = o.where("o_totalprice > 80000").select(k.alias("k"), F.when(F.col("o_custkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("v"))
    return writes.load_labels(h, i, "k", "v")


@query("WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (1 + o_orderkey % 40)::INTEGER AS b FROM orders), m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM r) SELECT o_custkey, a, b FROM m WHERE a < until")
def overlap_violations(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (1 + F.col("o_orderkey") % 40).cast("int")).alias("b"))
    return writes.overlaps(o, ["o_custkey"], "a", "b")


_ADJUSTED = (
    f"WITH {_DAILY}, x AS (SELECT stock_id, day, close, lag(close) OVER w AS previous, close - CASE WHEN stock_id % 17 = 0 AND extract(day FROM day) = 3 THEN NULL WHEN extract(day FROM day) <= 10 THEN close * 0.5::DOUBLE ELSE close - lag(close) OVER w END AS base FROM daily WINDOW w AS (PARTITION BY stock_id ORDER BY day)), "
    "f AS (SELECT stock_id, day, close, CASE WHEN previous IS NULL THEN FALSE ELSE base IS NULL OR base <= 0 OR NOT (base / previous BETWEEN 0.001 AND 1000) END AS broken, CASE WHEN previous IS NOT NULL AND base > 0 AND base / previous BETWEEN 0.001 AND 1000 AND base <> previous THEN base / previous ELSE 1.0 END AS factor FROM x), "
    "a AS (SELECT stock_id, day, close, coalesce(product(factor) OVER l, 1.0) AS scale, coalesce(bool_or(broken) OVER l, FALSE) AS cut FROM f WINDOW l AS (PARTITION BY stock_id ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
)


@query(f"{_ADJUSTED} SELECT stock_id, count(*) AS n, count(CASE WHEN NOT cut THEN 1 END) AS adjusted, round(ln(max(CASE WHEN NOT cut THEN close * scale END)), 4) AS most FROM a GROUP BY 1")
def adjusted_closes(spark, d):
    """Of the corpus's adjusted closes: how many of a stock there are, and the greatest."""
    a = _adjusted(spark, d)
    return a.groupBy("stock_id").agg(F.count("*").alias("n"), F.count("adjusted").alias("adjusted"), F.round(F.ln(F.max("adjusted")), 4).alias("most"))


@query(f"{_ADJUSTED} SELECT stock_id, day, CASE WHEN NOT cut THEN printf('%.10e', close * scale)::DOUBLE END AS adjusted FROM a")
def adjusted_close_rows(spark, d):
    """The corpus's adjusted closes, one by one, to 11 digits."""
    return _adjusted(spark, d, None).select("stock_id", "day", F.format_string("%.10e", "adjusted").try_cast("double").alias("adjusted"))


def _adjusted(spark, d, places=6):
    p = daily_prices(spark, d)
    before = F.lag("close").over(Window.partitionBy("stock_id").orderBy("day"))
    day = F.dayofmonth("day")
    change = F.when((F.col("stock_id") % 17 == 0) & (day == 3), None).when(day <= 10, F.col("close") * 0.5).otherwise(F.col("close") - before)
    events = timeseries.factor_events(p.withColumn("change", change), F.col("change"))
    first = F.lag("close").over(Window.partitionBy("stock_id").orderBy("day")).isNull()
    events = events.withColumn("broken", F.when(first, False).otherwise(F.col("broken")))
    return timeseries.adjusted_closes(events, places)


@query("WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS place, count(*) OVER (PARTITION BY o_custkey) AS total, nth_value(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM orders WHERE o_totalprice < 400000 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC)) SELECT o_custkey, o_orderkey, place, total > 3 AS has_more, CASE WHEN total > 3 THEN third END AS next_cursor FROM p WHERE place <= 3")
def first_pages(spark, d):
    """The first page of each customer's list, whether there is more, and the key that the next page goes on from."""
    every = Window.partitionBy("o_custkey")
    w = every.orderBy(F.col("o_totalprice").desc(), F.col("o_orderkey").desc())
    o = table(spark, d, "orders").where("o_totalprice < 400000").withColumn("place", F.row_number().over(w).cast("long")).withColumn("total", F.count("*").over(every)).where("place <= 3")
    more = F.col("total") > 3
    return o.withColumn("next_cursor", F.max(F.when(more & (F.col("place") == 3), F.col("o_orderkey"))).over(every)).select("o_custkey", "o_orderkey", "place", more.alias("has_more"), "next_cursor")


@query(
    "WITH d AS (SELECT p_type AS part, p_partkey, p_name, CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS brand FROM part), h AS (SELECT part, ('0x' || substr(md5(length(p_partkey::VARCHAR) || ':' || p_partkey || '|' || length(p_name) || ':' || p_name || '|' || coalesce(length(brand) || ':' || brand, '-') || '|' || length(part) || ':' || part), 1, 15))::BIGINT AS x FROM d) "
    "SELECT part, count(*) AS rows, sum(x)::VARCHAR AS digest FROM h GROUP BY 1"
)
def partition_digests(spark, d):
    """What tells two versions of a partition apart, whatever order and files its rows lie in."""
    from ..operators import versions

    p = table(spark, d, "part").select("p_partkey", "p_name", F.when(~(F.col("p_size") > 40), F.col("p_brand")).alias("brand"), F.col("p_type").alias("part"))
    return versions.digests(p, F.col("part"))
