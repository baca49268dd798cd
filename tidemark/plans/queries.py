"""The library's registered queries over the given tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asof, metrics, research, timeseries
from ..sources.tables import daily_prices, members, table, yearly_returns
from ..streaming import folds

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


_DAILY = "daily AS (SELECT l_partkey AS stock_id, l_shipdate::DATE AS day, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"
_RET = "ret AS (SELECT l_partkey AS stock_id, sum(l_extendedprice) FILTER (year(l_shipdate) = 1998) / nullif(sum(l_quantity) FILTER (year(l_shipdate) = 1998), 0) / (sum(l_extendedprice) FILTER (year(l_shipdate) = 1997) / nullif(sum(l_quantity) FILTER (year(l_shipdate) = 1997), 0)) - 1 AS ret FROM lineitem WHERE year(l_shipdate) IN (1997, 1998) GROUP BY 1)"
_MEMBERS = "members AS (SELECT p_brand AS theme_id, p_partkey AS stock_id, CASE WHEN p_size <= 25 THEN 'CORE' ELSE 'RELATED' END AS role, p_retailprice * p_size AS cap FROM part)"


def _weights(source: str, out: str = "weighted") -> str:
    return f"""{out}_a AS (SELECT *, greatest(0.30::DOUBLE, 1.0::DOUBLE / count(*) OVER (PARTITION BY theme_id)) AS lim, row_number() OVER d AS i,
  sum(cap) OVER (PARTITION BY theme_id ORDER BY cap DESC, stock_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {source} WINDOW d AS (PARTITION BY theme_id ORDER BY cap DESC, stock_id)),
{out}_b AS (SELECT *, min(CASE WHEN cap * (1 - (i - 1) * lim) > lim * rest THEN 1 ELSE 0 END) OVER (PARTITION BY theme_id ORDER BY cap DESC, stock_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fixed FROM {out}_a),
{out} AS (SELECT *, CASE WHEN fixed = 1 THEN lim ELSE cap * (1 - sum(fixed) OVER (PARTITION BY theme_id) * lim) / sum(CASE WHEN fixed = 0 THEN cap END) OVER (PARTITION BY theme_id) END AS weight FROM {out}_b)"""


_METRICS = f"""{_MEMBERS}, {_RET}, m AS (SELECT members.*, ret.ret FROM members LEFT JOIN ret USING (stock_id)), seen AS (SELECT * FROM m WHERE ret IS NOT NULL), {_weights("seen")},
v AS (SELECT theme_id, sum(weight * ret) AS weighted_return, median(ret) AS median_return, count(*) FILTER (ret > 0) AS advancing, count(*) AS valid FROM weighted GROUP BY 1),
c AS (SELECT theme_id, count(*) AS total, count(*) FILTER (role = 'CORE') AS core, coalesce(sum(cap) FILTER (role = 'CORE' AND ret IS NOT NULL), 0) / nullif(sum(cap) FILTER (role = 'CORE'), 0) AS core_ratio, count(ret) / count(*) AS total_ratio, count(ret) FILTER (role = 'CORE') AS core_seen FROM m GROUP BY 1),
metrics AS (SELECT c.*, v.weighted_return, v.median_return, v.advancing, coalesce(v.valid, 0) AS valid, v.advancing / nullif(v.valid, 0) AS breadth,
  CASE WHEN core_ratio IS NULL OR core_seen < 2 OR coalesce(valid, 0) < 3 THEN 'INSUFFICIENT' WHEN core_ratio >= 0.8 AND total_ratio >= 0.7 THEN 'SUFFICIENT' ELSE 'PARTIAL' END AS status FROM c LEFT JOIN v USING (theme_id))"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.theme_metrics(members(spark, d), yearly_returns(spark, d, 1997, 1998))


@query(f"WITH {_MEMBERS}, {_weights('members')} SELECT theme_id, stock_id, round(weight, 6) AS weight FROM weighted")
def capped_weights(spark, d):
    return metrics.capped_weights(members(spark, d)).select("theme_id", "stock_id", r6("weight").alias("weight"))


@query(f"WITH {_METRICS} SELECT theme_id, total, core, valid, advancing, round(core_ratio, 6) AS core_ratio, round(breadth, 6) AS breadth, round(weighted_return, 6) AS weighted_return, round(median_return, 6) AS median_return, status FROM metrics")
def theme_metrics(spark, d):
    return _metrics(spark, d).select("theme_id", "total", "core", "valid", "advancing", r6("core_ratio").alias("core_ratio"), r6("breadth").alias("breadth"), r6("weighted_return").alias("weighted_return"), r6("median_return").alias("median_return"), "status")


@query(f"WITH {_METRICS} SELECT row_number() OVER (ORDER BY weighted_return DESC, theme_id) AS rank, theme_id, round(weighted_return, 6) AS weighted_return FROM metrics WHERE status = 'SUFFICIENT' AND weighted_return > 0")
def theme_return_rank(spark, d):
    return metrics.ranking(_metrics(spark, d)).select("rank", "theme_id", r6("weighted_return").alias("weighted_return"))


@query(f"WITH {_METRICS}, k AS (SELECT theme_id, weighted_return FROM metrics WHERE status = 'SUFFICIENT' AND weighted_return > 0), x AS (SELECT *, min(weighted_return) OVER () AS lo, max(weighted_return) OVER () AS hi FROM k) SELECT theme_id, round(CASE WHEN hi = lo THEN least(abs(weighted_return) / 0.05, 1.0) ELSE 0.18 + 0.82 * (weighted_return - lo) / (hi - lo) END, 6) AS intensity FROM x")
def treemap_intensity(spark, d):
    return metrics.intensity(metrics.ranking(_metrics(spark, d))).select("theme_id", r6("intensity").alias("intensity"))


@query(f"WITH {_MEMBERS}, {_RET}, x AS (SELECT theme_id, stock_id, ret, row_number() OVER (PARTITION BY theme_id ORDER BY ret DESC, stock_id) AS place FROM members JOIN ret USING (stock_id) WHERE ret IS NOT NULL) SELECT theme_id, stock_id, round(ret, 6) AS ret, place FROM x WHERE place <= 3")
def theme_leaders(spark, d):
    return metrics.leaders(members(spark, d), yearly_returns(spark, d, 1997, 1998)).select("theme_id", "stock_id", r6("ret").alias("ret"), "place")


@query(f"WITH {_MEMBERS}, {_RET} SELECT theme_id, count(ret) AS n, round(avg(ret), 6) AS avg_ret FROM members LEFT JOIN ret USING (stock_id) GROUP BY 1 HAVING count(ret) >= 5")
def theme_simple_return(spark, d):
    m = members(spark, d).join(yearly_returns(spark, d, 1997, 1998), "stock_id", "left")
    return m.groupBy("theme_id").agg(F.count("ret").alias("n"), r6(F.avg("ret")).alias("avg_ret")).where("n >= 5")


@query("WITH x AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS place FROM events WHERE ts <= TIMESTAMP '2024-01-20') SELECT user_id, max(event_id) AS event_id, count(*) AS ties FROM x WHERE place = 1 GROUP BY 1")
def asof_latest_per_user(spark, d):
    e = table(spark, d, "events").withColumn("minus", -F.col("event_id"))
    w = asof.latest_known(e, ["user_id"], ["ts"], F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))
    return w.select("user_id", "event_id", "ties")


@query("WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase') SELECT p.event_id, p.user_id, c.event_id AS click_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts")
def asof_join_events(spark, d):
    e = table(spark, d, "events")
    out = asof.asof_join(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "user_id", "ts", "event_id")
    return out.select("event_id", "user_id", F.col("asof_value").alias("click_id"))


@query(f"WITH {_DAILY}, c AS (SELECT DISTINCT day FROM daily) SELECT day, lag(day) OVER (ORDER BY day) AS previous_day, row_number() OVER (ORDER BY day) AS day_number FROM c")
def previous_trading_day(spark, d):
    return asof.previous_days(daily_prices(spark, d))


@query("SELECT user_id, event_type, min(ts::DATE) AS first_date, max(ts::DATE) AS last_date, count(DISTINCT ts::DATE) AS day_count FROM events GROUP BY 1, 2")
def name_windows(spark, d):
    return asof.name_windows(table(spark, d, "events"), "user_id", "event_type", F.to_date("ts"))


@query("WITH w AS (SELECT user_id, event_type AS name, min(ts::DATE) AS first_date, max(ts::DATE) AS last_date FROM events GROUP BY 1, 2), q AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events) SELECT user_id, day, count(DISTINCT name) FILTER (day BETWEEN first_date AND last_date) AS n_valid, CASE count(DISTINCT name) FILTER (day BETWEEN first_date AND last_date) WHEN 1 THEN 'RESOLVED' WHEN 0 THEN 'OUT_OF_VALIDITY' ELSE 'AMBIGUOUS' END AS status FROM q LEFT JOIN w USING (user_id) GROUP BY 1, 2")
def interval_alias_join(spark, d):
    e = table(spark, d, "events")
    w = asof.name_windows(e, "user_id", "event_type", F.to_date("ts")).withColumnRenamed("event_type", "name")
    return asof.resolve_alias(e.select("user_id", F.to_date("ts").alias("day")).distinct(), w, "user_id")


@query(f"WITH {_DAILY}, x AS (SELECT stock_id, day, " + ", ".join(f"round((lead(close, {h}) OVER w / close * 100 - 100), 6) AS fwd_{h}" for h in (1, 5, 20)) + " FROM daily WINDOW w AS (PARTITION BY stock_id ORDER BY day)) SELECT * FROM x")
def forward_returns(spark, d):
    f = timeseries.forward_returns(daily_prices(spark, d))
    return f.select("stock_id", "day", *[r6(f"fwd_{h}").alias(f"fwd_{h}") for h in (1, 5, 20)])


@query(f"WITH {_DAILY}, {_MEMBERS}, c AS (SELECT day, lag(day) OVER (ORDER BY day) AS previous_day FROM (SELECT DISTINCT day FROM daily)), r AS (SELECT n.stock_id, n.day, n.close / b.close * 100 - 100 AS ret FROM daily n JOIN c USING (day) JOIN daily b ON b.stock_id = n.stock_id AND b.day = c.previous_day) SELECT theme_id, day, round(avg(ret), 6) AS basket_return, count(ret) AS n FROM members JOIN r USING (stock_id) GROUP BY 1, 2")
def basket_daily_return(spark, d):
    p = daily_prices(spark, d)
    return timeseries.basket_returns(members(spark, d), p, asof.previous_days(p)).select("theme_id", "day", r6("basket_return").alias("basket_return"), "n")


@query("WITH v AS (SELECT user_id AS stock_id, hour(ts) // 6 AS bucket, date_diff('day', DATE '2024-01-01', ts::DATE) AS day_number, sum(value) AS value FROM events GROUP BY 1, 2, 3), x AS (SELECT a.stock_id, a.bucket, a.day_number, a.value, count(b.value) AS n_past, median(b.value) AS mid FROM v a LEFT JOIN v b ON a.stock_id = b.stock_id AND a.bucket = b.bucket AND b.day_number BETWEEN a.day_number - 20 AND a.day_number - 1 GROUP BY 1, 2, 3, 4) SELECT stock_id, bucket, day_number, n_past, round(CASE WHEN n_past >= 5 AND mid > 0 THEN value / mid END, 6) AS multiple FROM x")
def same_time_baseline(spark, d):
    e = table(spark, d, "events")
    v = e.groupBy(F.col("user_id").alias("stock_id"), F.floor(F.hour("ts") / 6).alias("bucket"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day_number")).agg(F.sum("value").alias("value"))
    return timeseries.same_time_multiple(v).select("stock_id", "bucket", "day_number", F.col("n_past").cast("long").alias("n_past"), r6("multiple").alias("multiple"))


_SIGNALS = "s AS (SELECT user_id AS key, date_diff('day', DATE '2024-01-01', ts::DATE) AS day_number, CASE WHEN count(*) FILTER (event_type = 'error') >= 2 THEN NULL ELSE bool_or(event_type = 'purchase') END AS is_attention FROM events GROUP BY 1, 2)"


def _signals(spark, d):
    e = table(spark, d, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return e.groupBy(F.col("user_id").alias("key"), day.alias("day_number")).agg(F.when(F.count_if(F.col("event_type") == "error") >= 2, None).otherwise(F.bool_or(F.col("event_type") == "purchase")).alias("is_attention"))


@query(f"""WITH {_SIGNALS}, a AS (SELECT *, sum(CASE WHEN is_attention = false THEN 0 ELSE 1 END) OVER w AS reset FROM s WINDOW w AS (PARTITION BY key ORDER BY day_number)),
b AS (SELECT *, sum(CASE WHEN is_attention = false THEN 1 ELSE 0 END) OVER (PARTITION BY key, reset ORDER BY day_number) AS absent FROM a),
c AS (SELECT *, sum(CASE WHEN absent = 4 AND is_attention = false THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY day_number) AS ended FROM b),
t AS (SELECT *, CASE WHEN lag(ended) OVER w IS NULL OR ended > lag(ended) OVER w THEN 1 ELSE 0 END AS starts FROM c WHERE is_attention WINDOW w AS (PARTITION BY key ORDER BY day_number)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY day_number) AS island FROM t)
SELECT key, island::BIGINT AS island, min(day_number) AS first_day, max(day_number) AS last_day, count(*) AS attention_days FROM i GROUP BY 1, 2""")
def attention_islands(spark, d):
    return timeseries.attention_islands(_signals(spark, d), 4)


@query(f"WITH {_DAILY}, x AS (SELECT stock_id, day, close, close - CASE WHEN stock_id % 7 = 0 THEN NULL ELSE close * (2 - stock_id % 5) / 20.0::DOUBLE END AS base, lag(close) OVER (PARTITION BY stock_id ORDER BY day) AS previous FROM daily) SELECT stock_id, day, round(base / nullif(previous, 0), 6) AS ratio, coalesce(previous IS NOT NULL AND (base IS NULL OR base <= 0 OR NOT (base / previous BETWEEN 0.001 AND 1000)), true) AS broken FROM x")
def factor_detect(spark, d):
    p = daily_prices(spark, d)
    f = timeseries.factor_events(p, _change())
    return f.select("stock_id", "day", r6(F.try_divide("base", "previous")).alias("ratio"), "broken")


def _change():
    return F.when(F.col("stock_id") % 7 != 0, F.col("close") * (2 - F.col("stock_id") % 5) / 20.0)


@query(f"""WITH {_DAILY}, x AS (SELECT stock_id, day, close, close - CASE WHEN stock_id % 7 = 0 THEN NULL ELSE close * (2 - stock_id % 5) / 20.0::DOUBLE END AS base, lag(close) OVER (PARTITION BY stock_id ORDER BY day) AS previous FROM daily),
f AS (SELECT *, coalesce(previous IS NOT NULL AND (base IS NULL OR base <= 0 OR NOT (base / previous BETWEEN 0.001 AND 1000)), true) AS broken FROM x),
g AS (SELECT *, CASE WHEN previous IS NOT NULL AND NOT broken AND base <> previous THEN base / previous ELSE 1.0 END AS factor FROM f),
h AS (SELECT stock_id, day, close, coalesce(product(factor) OVER w, 1.0) AS scale, coalesce(bool_or(broken) OVER w, false) AS cut FROM g WINDOW w AS (PARTITION BY stock_id ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT stock_id, count(*) AS days, count(CASE WHEN NOT cut THEN 1 END) AS adjusted_days, round(avg(CASE WHEN NOT cut THEN ln(close * scale) END), 4) AS mean_log FROM h GROUP BY 1""")
def adjusted_close(spark, d):
    f = timeseries.factor_events(daily_prices(spark, d), _change())
    later = Window.partitionBy("stock_id").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = f.withColumn("scale", F.coalesce(F.product("factor").over(later), F.lit(1.0))).withColumn("cut", F.coalesce(F.max("broken").over(later), F.lit(False)))
    return h.groupBy("stock_id").agg(F.count("*").alias("days"), F.count_if(~F.col("cut")).alias("adjusted_days"), F.round(F.avg(F.when(~F.col("cut"), F.log(F.col("close") * F.col("scale")))), 4).alias("mean_log"))


@query("WITH t AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_totalprice > 450000), r AS (SELECT unnest(generate_series((SELECT min(day) FROM t), (SELECT max(day) FROM t), INTERVAL 1 DAY))::DATE AS day) SELECT day FROM r WHERE isodow(day) < 6 AND day NOT IN (SELECT day FROM t)")
def weekday_gaps(spark, d):
    """Weekdays without a large order, between the first and the last one."""
    days = table(spark, d, "orders").where("o_totalprice > 450000").select(F.to_date("o_orderdate").alias("day")).distinct()
    every = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return every.where(F.weekday("day") < 5).join(days, "day", "left_anti")


@query("SELECT user_id, date_trunc('hour', ts) AS bucket, arg_max(value, event_id) AS last_value, count(*) AS n FROM events GROUP BY 1, 2")
def minute_bucket_last(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("bucket")).agg(F.max_by("value", "event_id").alias("last_value"), F.count("*").alias("n"))


@query("WITH x AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, count(*) FILTER (NOT coalesce(ts < seen, false)) AS applied, count(*) FILTER (coalesce(ts < seen, false)) AS stale FROM x GROUP BY 1")
def hot_state_fold(spark, d):
    return folds.latest_state(table(spark, d, "events"))


@query("WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, CASE WHEN now - last <= INTERVAL 6 HOUR THEN 'FRESH' WHEN now - last <= INTERVAL 12 HOUR THEN 'LOW_CONFIDENCE' ELSE 'STALE' END AS status FROM l, n")
def freshness_coverage(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    age = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    hour = 3_600_000_000
    # one row joins
    return e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(now)).withColumn("age", age).select("user_id", F.when(F.col("age") <= 6 * hour, "FRESH").when(F.col("age") <= 12 * hour, "LOW_CONFIDENCE").otherwise("STALE").alias("status"))


@query("SELECT user_id, min(value) AS priority, max(ts) AS observed, count(*) AS signals, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS themes FROM events GROUP BY 1")
def demand_aggregation(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("priority"), F.max("ts").alias("observed"), F.count("*").alias("signals"), F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("themes"))


@query("WITH a AS (SELECT user_id, min(value) AS priority, count(*) AS signals, max(ts) AS observed FROM events GROUP BY 1) SELECT user_id, row_number() OVER (ORDER BY priority, signals DESC, observed DESC, user_id) AS place FROM a QUALIFY place <= 40")
def subscription_topk(spark, d):
    a = table(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("priority"), F.count("*").alias("signals"), F.max("ts").alias("observed"))
    top = a.orderBy("priority", F.desc("signals"), F.desc("observed"), "user_id").limit(40)
    return top.select("user_id", F.row_number().over(Window.orderBy("priority", F.desc("signals"), F.desc("observed"), "user_id")).cast("long").alias("place"))


@query("WITH x AS (SELECT *, lag(ts) OVER w AS before, lag(event_id) OVER w AS last_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, count(*) AS n, count(*) FILTER (ts < before) AS regressions, round(max(epoch_us(ts) - epoch_us(before)) / 1e6, 3) AS max_gap_s, quantile_disc(value, 0.95) AS p95 FROM x GROUP BY 1")
def tick_audit(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = table(spark, d, "events").withColumn("before", F.lag("ts").over(w)).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp")))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("us") < 0).alias("regressions"), F.round(F.max("us") / 1e6, 3).alias("max_gap_s"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


@query("WITH u AS (SELECT *, 0 AS source_rank FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT *, 1 FROM events WHERE event_type = 'purchase') SELECT event_id, source_rank, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, source_rank, event_id) AS position FROM u")
def kway_merge(spark, d):
    e = table(spark, d, "events")
    return folds.merged([e.where("event_type in ('click', 'view')"), e.where("event_type = 'purchase'")], "ts", "event_id").select("event_id", "source_rank", "position")


@query("WITH e AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1, 2), c AS (SELECT user_id, ts::DATE AS day, count(*) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT user_id, day, CASE WHEN n IS NULL THEN 'NO_EVENT' WHEN m IS NULL THEN 'UNMATCHED' ELSE 'MATCHED' END AS status FROM e FULL JOIN c USING (user_id, day)")
def reconcile_full_outer(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    left = e.where("event_type = 'click'").groupBy("user_id", "day").agg(F.count("*").alias("n"))
    right = e.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.count("*").alias("m"))
    return left.join(right, ["user_id", "day"], "full").select("user_id", "day", F.when(F.col("n").isNull(), "NO_EVENT").when(F.col("m").isNull(), "UNMATCHED").otherwise("MATCHED").alias("status"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def exact_dedup(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("SELECT lang, source, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2")
def null_safe_dedup(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderkey) OVER w AS next_key, lead(o_orderdate) OVER w AS next_date FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_orderkey AS event_id, next_key, date_diff('day', o_orderdate::DATE, next_date::DATE) AS days FROM x WHERE next_key IS NOT NULL")
def project_timeline(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.lead("o_orderkey").over(w).alias("next_key"), F.datediff(F.to_date(F.lead("o_orderdate").over(w)), F.to_date("o_orderdate")).cast("long").alias("days"))
    return x.where("next_key is not null")


@query("SELECT user_id, count(DISTINCT lower(trim(event_type))) AS sources, CASE WHEN count(DISTINCT lower(trim(event_type))) >= 2 THEN 'MULTI_SOURCE' ELSE 'SINGLE_SOURCE' END AS status FROM events GROUP BY 1")
def multi_source_status(spark, d):
    a = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct(F.lower(F.trim("event_type"))).alias("sources"))
    return a.withColumn("status", F.when(F.col("sources") >= 2, "MULTI_SOURCE").otherwise("SINGLE_SOURCE"))


@query("WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, event_id, event_type FROM x WHERE event_type IS DISTINCT FROM before")
def change_only_revision(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").withColumn("before", before).where("not event_type <=> before").select("user_id", "event_id", "event_type")


@query("WITH g AS (SELECT p_brand, list_sort(list(p_retailprice)) AS v FROM part GROUP BY 1) SELECT p_brand, len(v) AS n, v[(len(v) // 2 + 1)::BIGINT] AS upper_median, v[(len(v) // 4 + 1)::BIGINT] AS p25 FROM g")
def group_median_p25(spark, d):
    return research.at_fraction(table(spark, d, "part"), ["p_brand"], "p_retailprice", {"upper_median": 0.5, "p25": 0.25})


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('salt-1|' || doc_id), doc_id) AS i FROM documents) WHERE i <= 20")
def stable_sample(spark, d):
    w = Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("salt-1|"), F.col("doc_id").cast("string")), 256), "doc_id")
    return table(spark, d, "documents").select("doc_id", "lang", F.row_number().over(w).alias("i")).where("i <= 20").select("doc_id", "lang")


@query("SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS good, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def gold_scoring(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count("*").alias("n"), r6(F.avg((F.col("quality") == 1).cast("double"))).alias("good"), r6(F.avg((F.col("toxic") == 1).cast("double"))).alias("toxic"))


@query("WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS v FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1) SELECT user_id, CASE WHEN a.v IS NULL THEN 'ADDED' WHEN b.v IS NULL THEN 'ENDED' WHEN a.v <> b.v THEN 'CHANGED' ELSE 'SAME' END AS change FROM a FULL JOIN b USING (user_id)")
def scd2_diff(spark, d):
    e = table(spark, d, "events")
    at = lambda cond, name: e.where(cond).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias(name))
    a, b = at(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"), "a"), at(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"), "b")
    return a.join(b, "user_id", "full").select("user_id", F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "ENDED").when(F.col("a") != F.col("b"), "CHANGED").otherwise("SAME").alias("change"))


@query("WITH v AS (SELECT max(o_orderdate::DATE) AS version FROM orders) SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders, v WHERE o_orderdate::DATE = version GROUP BY 1")
def current_artifact(spark, d):
    o = table(spark, d, "orders")
    version = o.agg(F.to_date(F.max("o_orderdate")).alias("version"))
    return o.join(F.broadcast(version), F.to_date("o_orderdate") == F.col("version")).groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))


_A, _B = "SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 80", "SELECT user_id FROM events WHERE event_type = 'error' AND value > 80"


def _two(spark, d):
    e = table(spark, d, "events").where("value > 80")
    return e.where("event_type = 'purchase'").select("user_id"), e.where("event_type = 'error'").select("user_id")


@query(f"{_A} UNION {_B}")
def set_union(spark, d):
    a, b = _two(spark, d)
    return a.union(b).distinct()


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark, d):
    a, b = _two(spark, d)
    return a.intersect(b)


@query(f"{_A} EXCEPT {_B}")
def set_except(spark, d):
    a, b = _two(spark, d)
    return a.subtract(b)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (200000, 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50")
def keyset_page(spark, d):
    o = table(spark, d, "orders").where((F.col("o_totalprice") < 200000) | ((F.col("o_totalprice") == 200000) & (F.col("o_orderkey") < 0)))
    return o.orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_totalprice")


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^http://', 'https://'), '^https://(www|m)\.', 'https://'), '([?&])(ref|utm_[a-z]+)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[?&/]+$', '') AS url FROM pages")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("WITH x AS (SELECT doc_id, lower(text) AS t FROM documents), y AS (SELECT doc_id, list_sort(list_filter([" + ", ".join(f"CASE WHEN strpos(t, '{w}') > 0 THEN {{'at': strpos(t, '{w}'), 'rank': {i}, 'type': '{t}'}} END" for i, (t, ws) in enumerate(T.VOCABULARY) for w in ws) + "], lambda z: z IS NOT NULL)) AS a FROM x) SELECT doc_id, a[1].type AS type FROM y")
def classify_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.catalyst_type(F.col("text")).alias("type"))


@query("SELECT doc_id, i AS clause_no, length(trim(c)) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, '.')) AS c, generate_subscripts(string_split(text, '.'), 1) - 1 AS i FROM documents) WHERE length(trim(c)) > 0")
def clause_split(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\."))).toDF("doc_id", "clause_no", "c")
    return c.select("doc_id", F.col("clause_no").cast("long").alias("clause_no"), F.length(F.trim("c")).cast("long").alias("n_chars")).where("n_chars > 0")


@query("SELECT doc_id, try_cast(nullif(regexp_extract(text, '([0-9]{1,9})', 1), '') AS BIGINT) AS first_value FROM documents")
def extract_values(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_number(F.col("text")).alias("first_value"))


@query(f"WITH {_DAILY}, x AS (SELECT stock_id, day, (close / lag(close) OVER (PARTITION BY stock_id ORDER BY day) - 1) * 100 AS ret FROM daily), k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ret DESC, stock_id) AS place FROM x WHERE ret IS NOT NULL) SELECT day, place, stock_id, round(ret, 6) AS ret FROM k WHERE place <= 3")
def q_day_movers(spark, d):
    w = Window.partitionBy("stock_id").orderBy("day")
    x = daily_prices(spark, d).withColumn("ret", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1) * 100).where("ret is not null")
    k = x.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("ret"), "stock_id")).cast("long"))
    return k.where("place <= 3").select("day", "place", "stock_id", r6("ret").alias("ret"))


@query("SELECT n_name, count(DISTINCT c_custkey) AS companies, count(o_orderkey) AS events, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q_theme_companies(spark, d):
    c = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("events"), F.sum("o_totalprice").alias("total"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("n_name").agg(F.countDistinct("c_custkey").alias("companies"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.round(F.coalesce(F.sum("total"), F.lit(0.0)), 2).alias("total"))
