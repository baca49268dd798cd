"""Questions about periods, roles and the trading calendar; the mapping of tables is that of the research queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, research, timeseries
from ..sources.tables import daily_prices, members, table
from .queries import _DAILY, query, r6
from .research import _MOVES, _moves

#: Ranks gained since BACK_HOURS ago that make a riser; what records without a primary catalyst are called; roles by rank.
RISER_GAIN, BACK_HOURS = 1, 6
UNCLASSIFIED = "UNCLASSIFIED"
ROLES = ("R", "A", "N")


@query(f"""WITH {_MOVES}, s AS (SELECT p_brand AS theme_id, day, count(*) FILTER (ret >= 0) AS up FROM moves JOIN part ON p_partkey = stock_id GROUP BY 1, 2),
n AS (SELECT theme_id, count(*) AS days FROM s WHERE up > 0 AND day >= DATE '1997-01-01' AND day < DATE '1998-01-01' GROUP BY 1)
SELECT theme_id, days, row_number() OVER (ORDER BY days DESC, theme_id) AS place FROM n""")
def q_period_summary(spark, d):
    """Days of 1997 on which a theme went up or was mixed. The last window holds one row a theme."""
    m = _moves(spark, d).join(members(spark, d).select("stock_id", "theme_id"), "stock_id")
    s = m.groupBy("theme_id", "day").agg(research.direction("ret").alias("direction"))
    n = s.where("direction in ('UP', 'MIXED') and day >= date '1997-01-01' and day < date '1998-01-01'").groupBy("theme_id").agg(F.count("*").alias("days"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("days"), "theme_id")).cast("long"))


@query("SELECT p_brand AS theme_id, p_partkey AS stock_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice * p_size DESC, p_partkey) AS place FROM part")
def q_theme_members(spark, d):
    w = Window.partitionBy("theme_id").orderBy(F.desc("cap"), "stock_id")
    return members(spark, d).select("theme_id", "stock_id", F.row_number().over(w).cast("long").alias("place"))


@query(f"WITH n AS (SELECT p_brand AS theme_id, coalesce(nullif(o_orderstatus, 'P'), '{UNCLASSIFIED}') AS catalyst, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT theme_id, catalyst, n, row_number() OVER (PARTITION BY theme_id ORDER BY n DESC, catalyst) AS place FROM n")
def q_theme_history(spark, d):
    """Records of a theme by primary catalyst; status P stands for none."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("theme_id"))
    o = table(spark, d, "orders").select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit(UNCLASSIFIED)).alias("catalyst"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    n = l.groupBy("theme_id", "catalyst").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("theme_id").orderBy(F.desc("n"), "catalyst")).cast("long"))


@query(f"""WITH {_DAILY}, f AS (SELECT stock_id, day, lead(close, 5) OVER (PARTITION BY stock_id ORDER BY day) / close * 100 - 100 AS ret FROM daily),
e AS (SELECT l_suppkey AS company, l_orderkey AS event, ret, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY ret) AS i, count(*) OVER (PARTITION BY l_suppkey, l_orderkey) AS n FROM lineitem JOIN f ON stock_id = l_partkey AND day = l_shipdate::DATE WHERE ret IS NOT NULL)
SELECT company, event, max(n) AS observed, count(*) FILTER (ret > 0) AS positive, round(max(CASE WHEN i = n // 2 + 1 THEN ret END), 6) AS upper_median FROM e GROUP BY 1, 2""")
def q_company_outcome(spark, d):
    """Per event of a company: returns five closes later, their upper median and how many rose."""
    f = timeseries.forward_returns(daily_prices(spark, d)).select("stock_id", "day", F.col("fwd_5").alias("ret")).where("ret is not null")
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("company"), F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("stock_id"), F.to_date("l_shipdate").alias("day"))
    # an event's returns, in order, come together once; however many there are, sorting them spills
    of, e = Window.partitionBy("company", "event"), l.join(f, ["stock_id", "day"])
    e = e.withColumn("i", F.row_number().over(of.orderBy("ret"))).withColumn("n", F.count("*").over(of))
    g = e.groupBy("company", "event").agg(F.max("n").alias("observed"), F.count_if(F.col("ret") > 0).alias("positive"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2) + 1, F.col("ret"))).alias("middle"))
    return g.select("company", "event", "observed", "positive", r6("middle").alias("upper_median"))


@query("SELECT l_suppkey AS company, p_brand AS theme_id, concat_ws('|', " + ", ".join(f"CASE WHEN bool_or(l_returnflag = '{r}') THEN '{r}' END" for r in ROLES) + ") AS roles, count(DISTINCT l_orderkey) AS catalysts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def company_theme_roles(spark, d):
    """Roles of a company in a theme, united over its catalysts and in order of rank."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("theme_id"))
    l = table(spark, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"))
    roles = F.concat_ws("|", *[F.when(F.bool_or(F.col("l_returnflag") == r), r) for r in ROLES])
    one = l.groupBy(F.col("l_suppkey").alias("company"), "theme_id").agg(roles.alias("roles"), F.countDistinct("l_orderkey").alias("catalysts"))
    return one.select("company", "theme_id", "roles", "catalysts")


@query("SELECT l_returnflag AS role, l_linestatus AS resolution, count(*) AS n FROM lineitem GROUP BY 1, 2")
def role_distribution(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("resolution")).agg(F.count("*").alias("n"))


@query(f"""WITH v AS (SELECT date_trunc('hour', ts) AS hour, event_type, round(sum(value), 4) AS total FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY total DESC, event_type) AS rank FROM v),
c AS (SELECT hour, max(hour) OVER (ORDER BY hour RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {BACK_HOURS} HOUR PRECEDING) AS before FROM (SELECT DISTINCT hour FROM r))
SELECT r.hour, r.event_type, o.rank - r.rank AS gain FROM r JOIN c USING (hour) JOIN r o ON o.hour = c.before AND o.event_type = r.event_type WHERE o.rank - r.rank >= {RISER_GAIN} AND r.total > o.total""")
def rising_fast(spark, d):
    """Ranks gained and a larger value, both against the latest publication BACK_HOURS ago or before."""
    v = table(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.round(F.sum("value"), 4).alias("total"))
    r = v.withColumn("rank", F.row_number().over(Window.partitionBy("hour").orderBy(F.desc("total"), "event_type")).cast("long"))
    gained = research.rank_changes(r.drop("total"), "hour", "event_type", BACK_HOURS * 3600).select("hour", "event_type", F.col("change").alias("gain"))
    fell = research.rank_changes(r.select("hour", "event_type", F.col("total").alias("rank")), "hour", "event_type", BACK_HOURS * 3600).select("hour", "event_type", F.col("change").alias("fall"))
    return gained.join(fell, ["hour", "event_type"]).where((F.col("gain") >= RISER_GAIN) & (F.col("fall") < 0)).select("hour", "event_type", "gain")


@query("""WITH n AS (SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(l_shipdate)::DATE FROM lineitem), INTERVAL 1 DAY))::DATE AS day),
s AS (SELECT r.day, CASE WHEN n > 0 THEN 1 ELSE 0 END AS o, CASE WHEN n IS NULL AND isodow(r.day) < 6 THEN 1 ELSE 0 END AS u FROM r LEFT JOIN n ON n.day = r.day),
c AS (SELECT day, o, u, sum(o) OVER w AS opened, sum(u) OVER w AS unresolved FROM s WINDOW w AS (ORDER BY day)),
x AS (SELECT o_orderkey, o_orderdate::DATE AS a, max(l_shipdate)::DATE AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN e.unresolved - e.u = f.unresolved THEN e.opened - e.o - f.opened END::BIGINT AS n FROM x JOIN c f ON f.day = a JOIN c e ON e.day = b WHERE b > a""")
def trading_days_between(spark, d):
    """Trading days strictly between an order and its last shipment; null if any day between them is unresolved."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    calendar = asof.calendar_counts(l.select(F.to_date("l_shipdate").alias("day")), o.agg(F.to_date(F.min("o_orderdate")).alias("first")))
    last = l.groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("b"))
    x = o.select("o_orderkey", F.to_date("o_orderdate").alias("a")).join(last, F.col("o_orderkey") == F.col("l_orderkey")).where("b > a")
    return asof.days_between(x, "a", "b", calendar).select("o_orderkey", "n")
