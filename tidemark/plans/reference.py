"""Queries over reference data: line items as dated, sourced and revised observations of the parts as stocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof
from ..operators import reference as R
from ..sources.tables import members, table
from .queries import _MEMBERS, query, r6

AT, DECISION = "1998-10-01", "1998-12-01"
_OBS = "obs AS (SELECT l_partkey AS stock_id, date_trunc('quarter', l_shipdate)::DATE AS effective_on, l_shipdate::DATE + l_linenumber::INTEGER AS known_at, l_linenumber % 3 AS revision, l_returnflag AS source, l_linestatus AS side, l_suppkey AS holder, l_extendedprice AS value, l_quantity AS quantity FROM lineitem)"
_SEEN = f"seen AS (SELECT * FROM obs WHERE effective_on <= DATE '{AT}' AND known_at <= DATE '{DECISION}')"


def at():
    return F.lit(AT).cast("date")


def decision():
    return F.lit(DECISION).cast("date")


def observations(spark, d):
    l = table(spark, d, "lineitem")
    return l.select(
        F.col("l_partkey").alias("stock_id"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("effective_on"), F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber").cast("int")).alias("known_at"),
        (F.col("l_linenumber") % 3).alias("revision"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("side"), F.col("l_suppkey").alias("holder"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("quantity"),
    )


def seen(spark, d):
    return observations(spark, d).where((F.col("effective_on") <= at()) & (F.col("known_at") <= decision()))


def stocks(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("stock_id"))


_SNAPS = f"{_OBS}, {_MEMBERS}, snaps AS (SELECT theme_id, stock_id, effective_on AS effective_from, date_trunc('month', known_at)::DATE AS known_at, revision AS version FROM obs JOIN members USING (stock_id)), top AS (SELECT *, rank() OVER (PARTITION BY theme_id ORDER BY effective_from DESC, known_at DESC) AS place FROM snaps WHERE effective_from <= DATE '{AT}' AND known_at <= DATE '{DECISION}'), v AS (SELECT theme_id, count(DISTINCT version) AS versions, max(version) AS version FROM top WHERE place = 1 GROUP BY 1), held AS (SELECT top.*, versions FROM top JOIN v USING (theme_id, version) WHERE place = 1)"


def _held(spark, d):
    s = observations(spark, d).join(members(spark, d), "stock_id").select("theme_id", "stock_id", F.col("effective_on").alias("effective_from"), F.to_date(F.date_trunc("month", "known_at")).alias("known_at"), F.col("revision").alias("version"))
    return R.membership(s, at(), decision())


@query(f"WITH {_SNAPS} SELECT theme_id, effective_from, known_at, version, count(DISTINCT stock_id) AS n_members, CASE WHEN max(versions) > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status FROM held GROUP BY 1, 2, 3, 4")
def membership_as_of(spark, d):
    return _held(spark, d).groupBy("theme_id", "effective_from", "known_at", "version").agg(F.countDistinct("stock_id").alias("n_members"), F.max("status").alias("status"))


@query(f"WITH {_SNAPS} SELECT DISTINCT stock_id, theme_id FROM held")
def affected_themes(spark, d):
    return _held(spark, d).select("stock_id", "theme_id").distinct()


def _agreed_sql(source: str, keys: str, order: str, payload: str = "value", more: str = "") -> str:
    return f"(SELECT {keys}, CASE WHEN count(DISTINCT {payload}) = 1 THEN max({payload}) END AS {payload}, CASE WHEN count(DISTINCT {payload}) = 1 THEN 'KNOWN' ELSE 'CONFLICT' END AS state{more} FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {order}) AS place FROM {source}) t WHERE place = 1 GROUP BY {keys})"


@query(f"WITH {_OBS}, x AS (SELECT *, rank() OVER (PARTITION BY stock_id ORDER BY known_at DESC) AS place FROM obs WHERE effective_on = DATE '{AT}' AND known_at <= DATE '{DECISION}') SELECT stock_id, known_at, CASE WHEN count(*) = 1 THEN max(value) END AS value, CASE WHEN count(*) > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status FROM x WHERE place = 1 GROUP BY 1, 2")
def reference_as_of(spark, d):
    top = R.on_top(seen(spark, d).where(F.col("effective_on") == at()), ["stock_id"], ["known_at"])
    return top.groupBy("stock_id", "known_at").agg(F.when(F.count("*") == 1, F.max("value")).alias("value"), F.when(F.count("*") > 1, "AMBIGUOUS").otherwise("RESOLVED").alias("status"))


@query(f"WITH {_OBS}, {_SEEN}, q AS (SELECT * FROM seen WHERE effective_on = DATE '{AT}') SELECT * FROM {_agreed_sql('q', 'stock_id', 'known_at DESC, revision DESC')}")
def latest_price(spark, d):
    return R.agreed(seen(spark, d).where(F.col("effective_on") == at()), ["stock_id"], ["known_at", "revision"], "value")


@query(f"WITH {_OBS}, {_SEEN} SELECT * FROM {_agreed_sql('seen', 'stock_id', 'effective_on DESC, known_at DESC, revision DESC', 'value', ', max(effective_on) AS effective_on')}")
def listed_shares_latest(spark, d):
    return R.agreed(seen(spark, d), ["stock_id"], ["effective_on", "known_at", "revision"], "value", "effective_on")


@query(f"WITH {_OBS}, k AS (SELECT *, lead(known_at) OVER (PARTITION BY stock_id, effective_on ORDER BY known_at, revision) AS known_to FROM obs), x AS (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY effective_on DESC, known_at DESC, revision DESC, value DESC) AS place FROM k WHERE effective_on <= DATE '{AT}' AND known_at <= DATE '{DECISION}' AND (known_to IS NULL OR known_to > DATE '{DECISION}')) SELECT stock_id, effective_on, known_at, revision FROM x WHERE place = 1")
def revision_store(spark, d):
    return R.store_as_of(observations(spark, d), at(), decision()).select("stock_id", "effective_on", "known_at", "revision")


@query(f"WITH {_OBS}, x AS (SELECT obs.*, p_size FROM obs JOIN part ON p_partkey = stock_id) SELECT stock_id, count(*) AS n, count(CASE WHEN effective_on = DATE '{AT}' AND known_at <= DATE '{DECISION}' AND revision <> 2 AND value > 0 THEN 1 END) AS usable, round(sum(CASE WHEN effective_on = DATE '{AT}' AND known_at <= DATE '{DECISION}' AND revision <> 2 AND value > 0 THEN value END), 4) AS reference, round(sum(CASE WHEN source <> 'R' AND value > 0 AND quantity > 0 AND (p_size - 10) / 50.0 > 0 THEN value * quantity * ((p_size - 10) / 50.0) END), 5) AS cap FROM x GROUP BY 1")
def reference_guards(spark, d):
    x = observations(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("stock_id"), "p_size"), "stock_id")
    ref = R.return_reference(F.col("value"), F.col("effective_on") == at(), F.col("known_at") <= decision(), F.col("revision") != 2)
    cap = R.free_float_cap(F.col("value"), F.col("quantity"), (F.col("p_size") - 10) / 50.0, F.col("source") != "R")
    return x.groupBy("stock_id").agg(F.count("*").alias("n"), F.count(ref).alias("usable"), F.round(F.sum(ref), 4).alias("reference"), F.round(F.sum(cap), 5).alias("cap"))


_CAL = "cal AS (SELECT l_shipdate::DATE AS day, l_linestatus AS source, l_shipdate::DATE + l_linenumber::INTEGER AS known_at, l_linenumber % 3 AS revision, max(l_quantity) > 5 AS is_open FROM lineitem GROUP BY 1, 2, 3, 4)"


@query(f"WITH {_CAL}, t AS (SELECT *, rank() OVER (PARTITION BY day, source ORDER BY known_at DESC, revision DESC) AS place FROM cal WHERE known_at <= DATE '{DECISION}'), f AS (SELECT day, bool_and(is_open) AS least, bool_or(is_open) AS most FROM t WHERE place = 1 GROUP BY 1) SELECT day, CASE WHEN most IS NULL THEN 'POINT_IN_TIME_UNAVAILABLE' WHEN least <> most THEN 'CONFLICT' WHEN most THEN 'OPEN' ELSE 'CLOSED' END AS state FROM (SELECT DISTINCT day FROM cal) LEFT JOIN f USING (day)")
def calendar_states(spark, d):
    l = table(spark, d, "lineitem")
    c = l.groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_linestatus").alias("source"), F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber").cast("int")).alias("known_at"), (F.col("l_linenumber") % 3).alias("revision")).agg((F.max("l_quantity") > 5).alias("is_open"))
    return R.resolve_calendar(c, decision())


@query("WITH s AS (SELECT o_orderdate::DATE AS day, count(*) AS records FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 350000 GROUP BY 1), e AS (SELECT unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM s), c AS (SELECT e.day, records IS NOT NULL AS open, records IS NULL AND isodow(e.day) < 6 AS unresolved FROM e LEFT JOIN s USING (day)), w AS (SELECT day, max(CASE WHEN open THEN day END) OVER b AS o, max(CASE WHEN unresolved THEN day END) OVER b AS u FROM c WINDOW b AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT day, CASE WHEN (u IS NULL OR u < o) AND day - o <= 370 THEN o END AS previous_day FROM w")
def previous_day_guarded(spark, d):
    t = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 350000").select(F.to_date("o_orderdate").alias("day"))
    return R.guarded_previous_day(asof.calendar_counts(t, t.agg(F.min("day").alias("day"))))


_SHARES = f"latest AS {_agreed_sql('seen', 'stock_id, source', 'effective_on DESC, known_at DESC, revision DESC', 'quantity', ', max(effective_on) AS effective_on')}, per AS (SELECT stock_id, min(struct_pack(source := source, effective_on := effective_on, quantity := quantity)) AS f, count(DISTINCT quantity) AS vals, bool_or(state = 'CONFLICT') AS torn FROM latest GROUP BY 1), issued AS (SELECT p_partkey AS stock_id, CASE WHEN f IS NULL THEN 'MISSING' WHEN vals > 1 OR torn THEN 'CONFLICT' WHEN DATE '{AT}' - f.effective_on > 180 THEN 'STALE' ELSE 'VERIFIED' END AS state, f FROM part LEFT JOIN per ON p_partkey = stock_id)"


def _issued(spark, d):
    f = seen(spark, d).withColumn("value", F.col("quantity"))
    return R.listed_shares(stocks(spark, d), f, at(), decision())


@query(f"WITH {_OBS}, {_SEEN}, {_SHARES} SELECT stock_id, state, CASE WHEN state IN ('VERIFIED', 'STALE') THEN f.quantity END AS value, f.effective_on AS effective_on FROM issued")
def listed_shares_by_source(spark, d):
    return _issued(spark, d)


_COVER = "cov AS (SELECT stock_id, CASE side WHEN 'F' THEN 'CONTROLLING_HOLDER' ELSE 'TREASURY' END AS category, source, effective_on, known_at, revision, quantity > 10 AS complete FROM seen), t AS (SELECT *, rank() OVER (PARTITION BY stock_id, category, source ORDER BY effective_on DESC, known_at DESC, revision DESC) AS place FROM cov), b AS (SELECT *, row_number() OVER (PARTITION BY stock_id, category ORDER BY effective_on DESC, source, complete) AS n FROM t WHERE place = 1), w AS (SELECT p_partkey AS stock_id, category FROM part, (VALUES ('CONTROLLING_HOLDER'), ('TREASURY')) c(category)), covered AS (SELECT w.stock_id, w.category, source, effective_on, CASE WHEN complete THEN 'COVERED' ELSE 'MISSING' END AS state FROM w LEFT JOIN b ON b.stock_id = w.stock_id AND b.category = w.category AND n = 1)"


def _covered(spark, d):
    c = seen(spark, d).withColumn("category", F.when(F.col("side") == "F", "CONTROLLING_HOLDER").otherwise("TREASURY")).withColumn("complete", F.col("quantity") > 10)
    return R.holding_coverage(stocks(spark, d), c)


@query(f"WITH {_OBS}, {_SEEN}, {_COVER} SELECT stock_id, category, source, effective_on, state FROM covered")
def holding_coverage(spark, d):
    return _covered(spark, d).select("stock_id", "category", "source", "effective_on", "state")


_HOLD = f"n AS (SELECT * EXCLUDE (holder), holder % 3 AS holder FROM (SELECT *, max(effective_on) OVER (PARTITION BY stock_id) AS newest FROM seen) WHERE effective_on = newest), h AS {_agreed_sql('n', 'stock_id, holder, source', 'known_at DESC, revision DESC', 'quantity', ', max(effective_on) AS effective_on')}, held AS (SELECT stock_id, holder, max(effective_on) AS effective_on, count(*) AS sources, CASE WHEN count(DISTINCT quantity) = 1 AND NOT bool_or(state = 'CONFLICT') THEN 'AGREED' ELSE 'CONFLICT' END AS state, CASE WHEN count(DISTINCT quantity) = 1 AND NOT bool_or(state = 'CONFLICT') THEN max(quantity) END AS shares FROM h GROUP BY 1, 2)"


def _holdings(spark, d):
    return R.select_holdings(seen(spark, d).withColumn("holder", F.col("holder") % 3).withColumn("shares", F.col("quantity")))


@query(f"WITH {_OBS}, {_SEEN}, {_HOLD} SELECT * FROM held")
def selected_holdings(spark, d):
    return _holdings(spark, d)


_FLOAT = "g AS (SELECT stock_id, sum(shares) AS held, bool_or(state = 'CONFLICT') AS torn FROM held GROUP BY 1), gap AS (SELECT stock_id, bool_or(state = 'MISSING') AS gap FROM covered GROUP BY 1), ff AS (SELECT i.stock_id, CASE WHEN i.state = 'CONFLICT' OR coalesce(torn, FALSE) THEN 'CONFLICT' WHEN i.state = 'MISSING' OR coalesce(gap, TRUE) THEN 'MISSING' WHEN i.state = 'STALE' THEN 'STALE' WHEN coalesce(held, 0) > i.f.quantity THEN 'CONFLICT' ELSE 'VERIFIED' END AS state, (i.f.quantity - coalesce(held, 0)) / nullif(i.f.quantity, 0) AS r FROM issued i LEFT JOIN g USING (stock_id) LEFT JOIN gap USING (stock_id))"


def _float(spark, d):
    return R.free_float(_issued(spark, d), _holdings(spark, d), _covered(spark, d))


@query(f"WITH {_OBS}, {_SEEN}, {_SHARES}, {_COVER}, {_HOLD}, {_FLOAT} SELECT stock_id, state, CASE WHEN state = 'VERIFIED' THEN round(r, 6) END AS ratio FROM ff")
def free_float(spark, d):
    return _float(spark, d).select("stock_id", "state", r6("ratio").alias("ratio"))


@query(f"WITH {_OBS}, {_SEEN}, {_SHARES}, {_MEMBERS}, m AS (SELECT theme_id, stock_id, coalesce(issued.state, 'MISSING') AS state FROM members LEFT JOIN issued USING (stock_id)) SELECT theme_id, count(*) AS total, count(*) FILTER (state = 'VERIFIED') AS observed, " + ", ".join(f"coalesce(string_agg(stock_id::VARCHAR, ',' ORDER BY stock_id) FILTER (state = '{s}'), '') AS {s.lower()}" for s in ("MISSING", "STALE", "CONFLICT")) + ", CASE WHEN count(*) FILTER (state = 'VERIFIED') / count(*) >= 0.8 THEN 'SUFFICIENT' WHEN count(*) FILTER (state = 'VERIFIED') > 0 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS status FROM m GROUP BY 1")
def reference_coverage(spark, d):
    return R.reference_coverage(members(spark, d), _issued(spark, d))


_BASE = "base AS (SELECT stock_id, min(value / quantity) AS base FROM seen WHERE effective_on = (SELECT max(effective_on) FROM seen) AND source = 'A' GROUP BY 1), clo AS " + _agreed_sql("(SELECT * FROM seen WHERE source <> 'A') o", "stock_id", "effective_on DESC, known_at DESC, revision DESC") + ", act AS " + _agreed_sql("(SELECT stock_id, effective_on, known_at, revision, quantity / 25 AS factor FROM seen WHERE side = 'F') o", "stock_id", "effective_on DESC, known_at DESC", "factor") + ", pac AS (SELECT p_partkey AS stock_id, base, clo.value AS close, factor, CASE WHEN base > 0 THEN 'IMPLIED_BASE' WHEN clo.state IS NULL THEN 'CLOSE_MISSING' WHEN clo.state = 'CONFLICT' THEN 'CLOSE_CONFLICT' WHEN act.state = 'CONFLICT' THEN 'ACTION_CONFLICT' WHEN act.state IS NULL THEN 'UNADJUSTED_CLOSE' ELSE 'ADJUSTED_CLOSE' END AS state FROM part LEFT JOIN base ON base.stock_id = p_partkey LEFT JOIN clo ON clo.stock_id = p_partkey LEFT JOIN act ON act.stock_id = p_partkey), pc AS (SELECT stock_id, state, CASE state WHEN 'IMPLIED_BASE' THEN base WHEN 'UNADJUSTED_CLOSE' THEN close WHEN 'ADJUSTED_CLOSE' THEN close * factor END AS value FROM pac)"


def _previous(spark, d):
    s = seen(spark, d)
    newest = s.agg(F.max("effective_on").alias("effective_on"))
    base = s.where("source = 'A'").join(F.broadcast(newest), "effective_on").groupBy("stock_id").agg(F.min(F.col("value") / F.col("quantity")).alias("base"))
    closes = R.agreed(s.where("source <> 'A'"), ["stock_id"], ["effective_on", "known_at", "revision"], "value").withColumnRenamed("value", "close")
    actions = R.agreed(s.where("side = 'F'").withColumn("factor", F.col("quantity") / 25), ["stock_id"], ["effective_on", "known_at"], "factor")
    return R.previous_adjusted_close(stocks(spark, d), base, closes, actions)


@query(f"WITH {_OBS}, {_SEEN}, {_BASE} SELECT stock_id, state, round(value, 8) AS value FROM pc")
def previous_adjusted_close(spark, d):
    return _previous(spark, d).select("stock_id", "state", F.round("value", 8).alias("value"))


@query(f"WITH {_OBS}, {_SEEN}, {_SHARES}, {_COVER}, {_HOLD}, {_FLOAT}, {_BASE}, s AS {_agreed_sql('seen', 'stock_id', 'effective_on DESC, known_at DESC, revision DESC', 'quantity')} SELECT pc.stock_id, pc.state AS close_state, round(pc.value, 8) AS close, ff.state AS float_state, CASE WHEN ff.state = 'VERIFIED' THEN round(r, 6) END AS ratio, coalesce(s.state, 'MISSING') AS share_state, s.quantity AS shares FROM pc LEFT JOIN ff USING (stock_id) LEFT JOIN s USING (stock_id)")
def build_references(spark, d):
    shares = R.agreed(seen(spark, d), ["stock_id"], ["effective_on", "known_at", "revision"], "quantity").select("stock_id", F.col("state").alias("share_state"), F.col("quantity").alias("shares"))
    x = _previous(spark, d).select("stock_id", F.col("state").alias("close_state"), F.round("value", 8).alias("close")).join(_float(spark, d).select("stock_id", F.col("state").alias("float_state"), r6("ratio").alias("ratio")), "stock_id", "left")
    return x.join(shares, "stock_id", "left").withColumn("share_state", F.coalesce("share_state", F.lit("MISSING")))


@query(f"WITH {_OBS}, {_SEEN}, {_BASE}, f AS (SELECT l_partkey AS stock_id, arg_min(l_extendedprice, (l_shipdate, l_extendedprice)) AS close FROM lineitem WHERE l_shipdate > DATE '{AT}' AND l_extendedprice > 0 GROUP BY 1) SELECT stock_id, round(value, 8) AS close, 'REFERENCE' AS origin FROM pc WHERE value IS NOT NULL UNION ALL SELECT stock_id, round(close, 8), 'STREAM' FROM f WHERE stock_id NOT IN (SELECT stock_id FROM pc WHERE value IS NOT NULL)")
def supplemented_references(spark, d):
    stream = table(spark, d, "lineitem").where(F.col("l_shipdate") > at()).select(F.col("l_partkey").alias("stock_id"), F.col("l_shipdate").alias("at"), F.col("l_extendedprice").alias("base_price"))
    return R.supplemented(_previous(spark, d).select("stock_id", F.col("value").alias("close")), stream).select("stock_id", F.round("close", 8).alias("close"), "origin")
