"""Queries over live metrics: guarded returns, weights with their residual, turnover, attention, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market as M
from ..operators import metrics, timeseries
from ..sources.tables import daily_prices, members, table
from .queries import _DAILY, _MEMBERS, _METRICS, _RET, _weights, query, r6
from .reference import _OBS, AT, DECISION, at, decision, observations

# references: the newest row of side O of each stock that was effective by the quarter; observations: of side F
_ROWS = f"""{_OBS}, a AS (SELECT *, row_number() OVER (PARTITION BY stock_id, side ORDER BY effective_on DESC, known_at DESC, value DESC) AS n FROM obs WHERE effective_on <= DATE '{AT}'),
rows AS (SELECT p_brand AS theme_id, p_partkey AS stock_id, r.effective_on AS ref_for, r.known_at AS ref_known, r.revision <> 2 AS ref_resolved, CASE WHEN r.quantity > 3 THEN r.value / r.quantity ELSE 0 END AS ref_close,
  o.effective_on AS obs_day, o.known_at AS obs_at, o.source = 'R' AND o.revision = 1 AS obs_halted, o.revision = 2 AND o.source = 'A' AS obs_unresolved, o.quantity > 4 AS obs_fresh, CASE WHEN o.quantity < 48 THEN o.value / o.quantity END AS obs_price
  FROM part LEFT JOIN a r ON r.stock_id = p_partkey AND r.side = 'O' AND r.n = 1 LEFT JOIN a o ON o.stock_id = p_partkey AND o.side = 'F' AND o.n = 1),
g AS (SELECT *, CASE WHEN ref_known IS NULL THEN 1 WHEN NOT ref_resolved THEN 2 WHEN ref_for <> DATE '{AT}' OR ref_known > DATE '{DECISION}' THEN 3 WHEN ref_close IS NULL OR ref_close <= 0 THEN 4 WHEN obs_at IS NULL THEN 5 WHEN obs_day <> DATE '{AT}' OR obs_at > DATE '{DECISION}' THEN 6 WHEN obs_halted THEN 7 WHEN obs_unresolved THEN 8 WHEN NOT obs_fresh THEN 9 WHEN obs_price IS NULL OR obs_price <= 0 THEN 10 END AS guard FROM rows),
guarded AS (SELECT theme_id, stock_id, CASE guard WHEN 1 THEN 'REFERENCE_PRICE_UNAVAILABLE' WHEN 2 THEN 'CORPORATE_ACTION_UNRESOLVED' WHEN 3 THEN 'POINT_IN_TIME_VIOLATION' WHEN 4 THEN 'REFERENCE_PRICE_UNAVAILABLE' WHEN 5 THEN 'MARKET_PRICE_UNAVAILABLE' WHEN 6 THEN 'POINT_IN_TIME_VIOLATION' WHEN 7 THEN 'TRADING_HALTED' WHEN 8 THEN 'CORPORATE_ACTION_UNRESOLVED' WHEN 9 THEN 'STALE_MARKET_DATA' WHEN 10 THEN 'MARKET_PRICE_UNAVAILABLE' END AS flag,
  CASE WHEN guard IN (1, 3, 4) THEN 'MISSING_REFERENCE_DATA' WHEN guard IN (2, 8) THEN 'CORPORATE_ACTION_UNRESOLVED' WHEN guard = 7 THEN 'TRADING_HALTED' WHEN guard IS NOT NULL THEN 'MISSING_MARKET_DATA' END AS reason, CASE WHEN guard IS NULL THEN obs_price / ref_close - 1 END AS ret FROM g)"""


def _guarded(spark, d):
    o = observations(spark, d).where(F.col("effective_on") <= at())
    newest = lambda side: o.where(F.col("side") == side).groupBy("stock_id").agg(F.max(F.struct("effective_on", "known_at", "value", "quantity", "revision", "source")).alias("x"))
    ref = newest("O").select("stock_id", F.col("x.effective_on").alias("ref_for"), F.col("x.known_at").alias("ref_known"), (F.col("x.revision") != 2).alias("ref_resolved"), F.when(F.col("x.quantity") > 3, F.col("x.value") / F.col("x.quantity")).otherwise(0.0).alias("ref_close"))
    obs = newest("F").select("stock_id", F.col("x.effective_on").alias("obs_day"), F.col("x.known_at").alias("obs_at"), ((F.col("x.source") == "R") & (F.col("x.revision") == 1)).alias("obs_halted"), ((F.col("x.revision") == 2) & (F.col("x.source") == "A")).alias("obs_unresolved"), (F.col("x.quantity") > 4).alias("obs_fresh"), F.when(F.col("x.quantity") < 48, F.col("x.value") / F.col("x.quantity")).alias("obs_price"))
    return M.stock_return(members(spark, d).join(ref, "stock_id", "left").join(obs, "stock_id", "left"), at(), decision())


@query(f"WITH {_ROWS} SELECT theme_id, stock_id, flag, reason, round(ret, 8) AS ret FROM guarded")
def stock_return(spark, d):
    return _guarded(spark, d).select("theme_id", "stock_id", "flag", "reason", F.round("ret", 8).alias("ret"))


@query(f"WITH {_ROWS} SELECT theme_id, count(*) AS total, count(ret) AS valid, coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag), '') AS flags, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons, CASE WHEN count(ret) > 0 THEN count(*) FILTER (ret > 0) END AS advancing, round(median(ret), 8) AS median_return FROM guarded GROUP BY 1")
def theme_quality(spark, d):
    g = _guarded(spark, d).groupBy("theme_id").agg(F.count("*").alias("total"), F.count("ret").alias("valid"), F.array_join(F.sort_array(F.collect_set("flag")), ",").alias("flags"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"), F.count_if(F.col("ret") > 0).alias("up"), F.round(F.median("ret"), 8).alias("median_return"))
    return g.select("theme_id", "total", "valid", "flags", "reasons", F.when(F.col("valid") > 0, F.col("up")).alias("advancing"), "median_return")


@query(
    f"WITH {_ROWS}, {_METRICS.replace(_RET, 'ret AS (SELECT stock_id, ret FROM guarded WHERE ret IS NOT NULL)')}, q AS (SELECT theme_id, coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag), '') AS flags, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons, list(stock_id || ':' || flag ORDER BY stock_id) FILTER (flag IS NOT NULL) AS issues FROM guarded GROUP BY 1) "
    "SELECT theme_id, total, core, metrics.valid, advancing, round(core_ratio, 6) AS core_ratio, round(total_ratio, 6) AS total_ratio, round(breadth, 6) AS breadth, round(weighted_return, 6) AS weighted_return, round(median_return, 6) AS median_return, status, flags, reasons, coalesce(array_to_string(issues, ','), '') AS issues FROM metrics JOIN q USING (theme_id)"
)
def theme_report(spark, d):
    """All metrics of a theme at the decision in one row: returns that passed the guards, coverage, breadth, flags, reasons and the member behind each flag."""
    g = _guarded(spark, d)
    m = metrics.theme_metrics(members(spark, d), g.where("ret is not null").select("stock_id", "ret"))
    issues = F.transform(F.array_sort(F.collect_list(F.when(F.col("flag").isNotNull(), F.struct("stock_id", "flag")))), lambda x: F.concat(x["stock_id"].cast("string"), F.lit(":"), x["flag"]))
    q = g.groupBy("theme_id").agg(F.array_join(F.sort_array(F.collect_set("flag")), ",").alias("flags"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"), F.array_join(issues, ",").alias("issues"))
    return m.join(q, "theme_id").select("theme_id", "total", "core", "valid", "advancing", *[r6(c).alias(c) for c in ("core_ratio", "total_ratio", "breadth", "weighted_return", "median_return")], "status", "flags", "reasons", "issues")


@query(f"WITH {_MEMBERS}, {_weights('members')}, r AS (SELECT *, round(weight, 4) AS w, round(1 - sum(round(weight, 4)) OVER (PARTITION BY theme_id), 4) AS residual, max(lim) OVER (PARTITION BY theme_id) AS most FROM weighted), f AS (SELECT *, min(CASE WHEN CASE WHEN residual > 0 THEN w + residual <= most + 1e-12 ELSE w + residual >= 0 END THEN stock_id END) OVER (PARTITION BY theme_id) AS first_id FROM r) SELECT theme_id, stock_id, round(CASE WHEN stock_id = first_id THEN w + residual ELSE w END, 4) AS weight FROM f")
def weights_with_residual(spark, d):
    n = F.count("*").over(metrics.Window.partitionBy("theme_id"))
    w = metrics.capped_weights(members(spark, d)).withColumn("most", F.greatest(F.lit(metrics.CAP), 1 / n))
    return M.with_residual(w, F.col("most"), 4).select("theme_id", "stock_id", "weight")


_TURN = """v AS (SELECT user_id AS stock_id, hour(ts) // 6 AS bucket, date_diff('day', DATE '2024-01-01', ts::DATE) AS day_number, sum(value) AS value, count(*) FILTER (event_type = 'error') < 2 AS usable FROM events GROUP BY 1, 2, 3),
mem AS (SELECT DISTINCT user_id % 12 AS theme_id, user_id AS stock_id, user_id % 9 AS since FROM events),
x AS (SELECT mem.theme_id, a.stock_id, a.bucket, a.day_number, a.value, a.usable, count(b.value) AS n_past, median(b.value) AS mid FROM mem JOIN v a ON a.stock_id = mem.stock_id AND a.day_number >= since LEFT JOIN v b ON b.stock_id = a.stock_id AND b.bucket = a.bucket AND b.usable AND b.day_number >= since AND b.day_number BETWEEN a.day_number - 20 AND a.day_number - 1 GROUP BY 1, 2, 3, 4, 5, 6),
y AS (SELECT *, CASE WHEN usable AND n_past >= 5 AND mid > 0 THEN mid END AS baseline FROM x),
tot AS (SELECT theme_id, bucket, day_number, count(*) AS total FROM mem JOIN (SELECT DISTINCT bucket, day_number FROM v) s ON since <= day_number GROUP BY 1, 2, 3),
z AS (SELECT theme_id, bucket, day_number, count(baseline) AS valid, sum(value) FILTER (baseline IS NOT NULL) AS now, sum(baseline) AS usual, min(n_past) FILTER (baseline IS NOT NULL) AS fewest, count(*) FILTER (value / baseline >= 2) AS high FROM y GROUP BY 1, 2, 3),
turn AS (SELECT tot.*, coalesce(valid, 0) AS valid, coalesce(high, 0) AS high, now / nullif(usual, 0) AS multiple, CASE WHEN coalesce(valid, 0) = 0 THEN 'INSUFFICIENT' WHEN valid = total AND fewest = 20 THEN 'FULL' ELSE 'PROVISIONAL' END AS status FROM tot LEFT JOIN z USING (theme_id, bucket, day_number))"""


def _turnover(spark, d):
    e = table(spark, d, "events")
    v = e.groupBy(F.col("user_id").alias("stock_id"), F.floor(F.hour("ts") / 6).alias("bucket"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day_number")).agg(F.sum("value").alias("value"), (F.count_if(F.col("event_type") == "error") < 2).alias("usable"))
    m = e.select((F.col("user_id") % 12).alias("theme_id"), F.col("user_id").alias("stock_id"), (F.col("user_id") % 9).alias("since")).distinct()
    return M.theme_turnover(v, m)


@query(f"WITH {_TURN} SELECT theme_id, bucket, day_number, total, valid, high, round(multiple, 6) AS multiple, status FROM turn")
def theme_turnover(spark, d):
    return _turnover(spark, d).select("theme_id", "bucket", "day_number", "total", "valid", "high", r6("multiple").alias("multiple"), "status")


# by trading days: weekdays on which anything traded, numbered; the look-back counts these
_TRADED = _TURN.replace("date_diff('day', DATE '2024-01-01', ts::DATE) AS day_number", "any_value(c.n) AS day_number").replace("FROM events GROUP BY 1, 2, 3),\nmem", "FROM events JOIN cal c ON c.day = ts::DATE GROUP BY 1, 2, c.n),\nmem")


@query(f"WITH cal AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS n FROM (SELECT DISTINCT ts::DATE AS day FROM events WHERE isodow(ts) < 6)), {_TRADED} SELECT theme_id, bucket, cal.day, total, valid, high, round(multiple, 6) AS multiple, status FROM turn JOIN cal ON cal.n = day_number")
def theme_turnover_by_trading_days(spark, d):
    """Turnover against the same time of the last trading days, not calendar days."""
    e = table(spark, d, "events")
    day = F.to_date("ts").alias("day")
    # one row a trading day
    cal = e.where(F.weekday("ts") < 5).select(day).distinct().withColumn("day_number", F.row_number().over(metrics.Window.orderBy("day")) - 1)
    v = e.withColumn("day", day).join(cal, "day").groupBy(F.col("user_id").alias("stock_id"), F.floor(F.hour("ts") / 6).alias("bucket"), F.col("day_number").cast("long").alias("day_number")).agg(F.sum("value").alias("value"), (F.count_if(F.col("event_type") == "error") < 2).alias("usable"))
    m = e.select((F.col("user_id") % 12).alias("theme_id"), F.col("user_id").alias("stock_id"), (F.col("user_id") % 9).alias("since")).distinct()
    return M.theme_turnover(v, m).join(cal, "day_number").select("theme_id", "bucket", "day", "total", "valid", "high", r6("multiple").alias("multiple"), "status")


_ATT = f"{_TURN}, daily_v AS (SELECT user_id % 12 AS theme_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day_number, sum(value) AS s, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT theme_id, day_number, s / lag(s) OVER (PARTITION BY theme_id ORDER BY day_number) - 1 AS weighted_return, CASE WHEN n >= 10 THEN 'SUFFICIENT' ELSE 'PARTIAL' END AS coverage FROM daily_v), att AS (SELECT turn.*, r.weighted_return, r.coverage, CASE WHEN coverage <> 'SUFFICIENT' THEN 'INSUFFICIENT_COVERAGE' WHEN multiple IS NULL OR weighted_return IS NULL OR valid < 3 THEN 'INSUFFICIENT_OBSERVATIONS' END AS reason FROM turn JOIN r USING (theme_id, day_number)), sig AS (SELECT *, CASE WHEN reason IS NULL THEN multiple >= 2 AND high >= 2 AND high / valid >= 0.3::DOUBLE AND weighted_return >= 0.01::DOUBLE END AS is_attention FROM att)"


def _attention(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy((F.col("user_id") % 12).alias("theme_id"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day_number")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    before = F.lag("s").over(metrics.Window.partitionBy("theme_id").orderBy("day_number"))
    r = s.select("theme_id", "day_number", (F.try_divide(F.col("s"), before) - 1).alias("weighted_return"), F.when(F.col("n") >= 10, "SUFFICIENT").otherwise("PARTIAL").alias("coverage"))
    return M.attention_day(_turnover(spark, d).join(r, ["theme_id", "day_number"]))


@query(f"WITH {_ATT} SELECT theme_id, bucket, day_number, valid, high, is_attention, reason FROM sig")
def attention_day(spark, d):
    return _attention(spark, d).select("theme_id", "bucket", "day_number", "valid", "high", "is_attention", "reason")


# the policy's 10 days; attention_islands registers 4, which the tables' 30 days can show
@query(
    f"WITH {_ATT}, k AS (SELECT theme_id * 4 + bucket AS key, day_number, CASE WHEN reason IS NULL THEN multiple >= 1.2 END AS a FROM att), q AS (SELECT *, sum(CASE WHEN a IS DISTINCT FROM FALSE THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY day_number ROWS UNBOUNDED PRECEDING) AS reset FROM k), "
    "b AS (SELECT *, sum(CASE WHEN NOT a THEN 1 ELSE 0 END) OVER (PARTITION BY key, reset ORDER BY day_number ROWS UNBOUNDED PRECEDING) AS absent FROM q), e AS (SELECT *, sum(CASE WHEN absent = 10 AND NOT a THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY day_number ROWS UNBOUNDED PRECEDING) AS ended FROM b), "
    "t AS (SELECT *, CASE WHEN lag(ended) OVER w IS NULL OR ended > lag(ended) OVER w THEN 1 ELSE 0 END AS starts FROM e WHERE a WINDOW w AS (PARTITION BY key ORDER BY day_number)), i AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY day_number ROWS UNBOUNDED PRECEDING) AS island FROM t) SELECT key, island, min(day_number) AS first_day, max(day_number) AS last_day, count(*) AS attention_days FROM i GROUP BY 1, 2"
)
def attention_islands_policy(spark, d):
    s = _attention(spark, d).select((F.col("theme_id") * 4 + F.col("bucket")).alias("key"), "day_number", F.when(F.col("reason").isNull(), F.col("multiple") >= 1.2).alias("is_attention"))
    return timeseries.attention_islands(s)


@query("WITH k AS (SELECT user_id % 12 AS key, event_id, ts FROM events), o AS (SELECT *, max(CASE WHEN ts <= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 300 MINUTE THEN ts END) OVER (PARTITION BY key) AS old FROM k) SELECT key, event_id FROM o WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' AND (ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 300 MINUTE OR ts = old)")
def rank_history(spark, d):
    k = table(spark, d, "events").select((F.col("user_id") % 12).alias("key"), "event_id", "ts")
    return M.rank_history(k, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), "300 minutes").select("key", "event_id")


@query("WITH t AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_totalprice > 490000), q AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), n AS (SELECT q.day, min(t.day) AS nd FROM q LEFT JOIN t ON t.day > q.day GROUP BY 1) SELECT day, CASE WHEN nd - day <= 14 THEN nd END AS next_day FROM n")
def next_trading_day(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return M.next_trading_day(o.select("day").distinct(), o.where("o_totalprice > 490000").select("day").distinct())


@query(f"WITH {_DAILY}, p AS (SELECT stock_id, day, close, CASE WHEN stock_id % 3 <> 0 THEN close * 0.9::DOUBLE END AS adjusted FROM daily), c AS (SELECT *, coalesce(adjusted, close) AS used FROM p) SELECT stock_id, day, round((used / lag(used) OVER (PARTITION BY stock_id ORDER BY day) - 1) * 100, 6) AS ret FROM c")
def adjusted_or_raw_return(spark, d):
    p = daily_prices(spark, d).withColumn("adjusted", F.when(F.col("stock_id") % 3 != 0, F.col("close") * 0.9)).withColumn("used", F.coalesce("adjusted", "close"))
    before = F.lag("used").over(metrics.Window.partitionBy("stock_id").orderBy("day"))
    return p.select("stock_id", "day", r6((F.try_divide(F.col("used"), before) - 1) * 100).alias("ret"))


@query("WITH s AS (SELECT DISTINCT date_trunc('hour', ts) AS start FROM events), c AS (SELECT DISTINCT s.start, user_id AS key FROM s JOIN events e ON event_type = 'signup' AND e.ts + INTERVAL 3 HOUR >= s.start AND e.ts < s.start + INTERVAL 1 HOUR), t AS (SELECT DISTINCT date_trunc('hour', ts) AS start, user_id AS key FROM events WHERE event_type = 'purchase') SELECT start, key FROM c EXCEPT SELECT start, key FROM t")
def gap_recovery(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    hour = F.date_trunc("hour", "ts")
    slots = e.select(hour.alias("start"), (hour + F.expr("INTERVAL 1 HOUR")).alias("end")).distinct()
    out = M.recovery_targets(e.where("event_type = 'signup'").select("key", "ts"), e.where("event_type = 'purchase'").select("key", "ts"), slots, "3 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "key")
