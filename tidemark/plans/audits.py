"""Audits over events as captured ticks: digests and order, coverage of trading hours by sessions and backfills, candidates with a time to live."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as A
from ..sources.tables import table
from ..streaming import timers
from .queries import query

# every 97th tick is missing; the digest is a tree of chunks of 4096 numbers
_TICKS = "t AS (SELECT event_id AS seq, event_type AS kind, ts, value, props, epoch_us(ts) // 1000 AS at_ms, (event_id * 7919) % 900 + CASE WHEN event_id % 53 = 0 THEN 5000 ELSE 0 END AS latency FROM events WHERE event_id % 97 <> 5)"


def _ticks(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").where(i % 97 != 5)
    return e.select(i.alias("seq"), F.col("event_type").alias("kind"), "ts", "value", "props", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), ((i * 7919) % 900 + F.when(i % 53 == 0, 5000).otherwise(0)).alias("latency"))


@query(
    f"WITH {_TICKS}, h AS (SELECT seq, seq // 4096 AS chunk, sha256(kind || '|' || at_ms || '|' || props) AS h, seq > lag(seq) OVER (ORDER BY seq) + 1 AS hole FROM t), a AS (SELECT chunk, sha256(string_agg(h, '' ORDER BY seq)) AS h FROM h GROUP BY 1), b AS (SELECT sha256(string_agg(h, '' ORDER BY chunk)) AS h FROM a) "
    "SELECT (SELECT count(*) FROM h) AS n, (SELECT min(seq) FROM h) AS first_seq, (SELECT max(seq) FROM h) AS last_seq, (SELECT max(seq) - min(seq) + 1 - count(*) FROM h) AS missing, (SELECT count(*) FILTER (hole) FROM h) AS holes, h AS digest FROM b"
)
def tick_digest(spark, d):
    """Whether the numbers are whole and the ticks as they were: a digest that order counts in, made of parallel ones."""
    return A.ordered_digest(_ticks(spark, d), "seq", F.concat_ws("|", "kind", F.col("at").cast("string"), "props"))


@query(
    f"WITH {_TICKS}, l AS (SELECT *, lag(at_ms) OVER (PARTITION BY kind ORDER BY seq) AS before FROM t) SELECT kind, count(*) AS n, count(*) FILTER (at_ms < before) AS regressions, max(greatest(at_ms - before, 0)) AS max_gap, count(*) FILTER (sha256(props) <> sha256('{{\"k\": ' || regexp_extract(props, '([0-9]+)', 1) || '}}')) AS torn, "
    "quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, quantile_disc(latency, 0.99) AS p99 FROM l GROUP BY 1"
)
def tick_audit(spark, d):
    """By type: ticks, receipts that go back, the longest silence, payloads that don't match, latencies of nearest rank in milliseconds."""
    t = _ticks(spark, d)
    torn = F.sha2("props", 256) != F.sha2(F.concat(F.lit('{"k": '), F.regexp_extract("props", "([0-9]+)", 1), F.lit("}")), 256)
    g = A.since_last(t).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("at") < F.col("before")).alias("regressions"), F.max(F.when(F.col("before").isNotNull(), F.greatest(F.col("at") - F.col("before"), F.lit(0)))).alias("max_gap"), F.count_if(torn).alias("torn"))
    return g.join(A.nearest_ranks(t, "kind", "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "kind")


# an API (event type) captures from a tick on for 40 minutes; purchases are backfills of the API of their number: two hours from their time, every third fails; wanted are 9:00 to 15:30
_COVER = """cap AS (SELECT event_type AS api, ts AS s, ts + INTERVAL 40 MINUTE AS e FROM events WHERE event_type IN ('click', 'view', 'error')),
bf AS (SELECT event_id, ['click', 'view', 'error'][event_id % 3 + 1] AS api, ts AS s, ts + INTERVAL 2 HOUR AS e, event_id % 4 <> 0 AS completed FROM events WHERE event_type = 'purchase'),
want AS (SELECT api, day + INTERVAL 9 HOUR AS s, day + INTERVAL 930 MINUTE AS e FROM (SELECT DISTINCT ts::DATE AS day FROM events), (VALUES ('click'), ('view'), ('error')) a(api)),
cov AS (SELECT api, s, e FROM cap UNION ALL SELECT api, s, e FROM bf WHERE completed)"""


def _gaps(name: str, cover: str) -> str:
    """Remaining gaps by merging what covers, then taking what lies between the merged parts within each wanted interval."""
    return f"""{name}_o AS (SELECT api, s, e, CASE WHEN s > max(e) OVER (PARTITION BY api ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM {cover}),
{name}_u AS (SELECT api, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY api ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}_o) GROUP BY api, g),
{name}_b AS (SELECT w.api, w.s AS ws, w.e AS we, greatest(u.s, w.s) AS s, least(u.e, w.e) AS e FROM want w JOIN {name}_u u ON u.api = w.api AND u.s < w.e AND u.e > w.s),
{name}_c AS (SELECT api, ws, we, s, e FROM {name}_b UNION ALL SELECT api, s, e, e, e FROM want),
{name} AS (SELECT api, coalesce(lag(e) OVER (PARTITION BY api, ws ORDER BY s, e), ws) AS s, s AS e FROM {name}_c QUALIFY coalesce(lag(e) OVER (PARTITION BY api, ws ORDER BY s, e), ws) < s)"""


def _intervals(spark, d):
    e = table(spark, d, "events").withColumn("start", F.col("ts"))
    api = F.get(F.array(*map(F.lit, ("click", "view", "error"))), (F.col("event_id") % 3).cast("int"))
    captured = e.where("event_type in ('click', 'view', 'error')").select(F.col("event_type").alias("api"), "start", (F.col("ts") + F.expr("INTERVAL 40 MINUTE")).alias("end"))
    backfills = e.where("event_type = 'purchase'").select("event_id", api.alias("api"), "start", (F.col("ts") + F.expr("INTERVAL 2 HOUR")).alias("end"), (F.col("event_id") % 4 != 0).alias("completed"))
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    days = e.select(day.alias("day")).distinct().withColumn("api", F.explode(F.array(*map(F.lit, ("click", "view", "error")))))
    wanted = days.select("api", (F.col("day") + F.expr("INTERVAL 9 HOUR")).alias("start"), (F.col("day") + F.expr("INTERVAL 930 MINUTE")).alias("end"))
    return wanted, captured, backfills


@query(f"WITH {_COVER}, {_gaps('gap', 'cov')} SELECT api, s AS start, e AS end_at FROM gap")
def capture_gaps(spark, d):
    """What of the trading hours neither a capture session nor a completed backfill covers."""
    wanted, captured, backfills = _intervals(spark, d)
    covering = captured.unionByName(backfills.where("completed").select("api", "start", "end"))
    return A.uncovered(wanted, covering, ["api"]).select("api", "start", F.col("end").alias("end_at"))


@query(
    f"WITH {_COVER}, {_gaps('gap', 'cov')}, {_gaps('raw', 'cap')}, w AS (SELECT api, sum(epoch_us(e) // 1000 - epoch_us(s) // 1000)::BIGINT AS wanted FROM want GROUP BY 1), g AS (SELECT api, count(*) AS gaps, sum(epoch_us(e) // 1000 - epoch_us(s) // 1000)::BIGINT AS lost, max(epoch_us(e) // 1000 - epoch_us(s) // 1000) AS max_gap FROM gap GROUP BY 1), r AS (SELECT api, sum(epoch_us(e) // 1000 - epoch_us(s) // 1000)::BIGINT AS uncaptured FROM raw GROUP BY 1), "
    "b AS (SELECT api, count(*) FILTER (completed) AS completed, count(*) FILTER (NOT completed) AS failed FROM bf GROUP BY 1), f AS (SELECT bf.api, count(DISTINCT event_id) AS broken FROM bf JOIN gap ON gap.api = bf.api AND gap.s < bf.e AND gap.e > bf.s WHERE NOT completed GROUP BY 1) "
    "SELECT w.api, wanted, coalesce(gaps, 0) AS gaps, coalesce(lost, 0)::BIGINT AS lost, coalesce(max_gap, 0) AS max_gap, (coalesce(uncaptured, 0) - coalesce(lost, 0))::BIGINT AS recovered, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(broken, 0) AS broken FROM w LEFT JOIN g USING (api) LEFT JOIN r USING (api) LEFT JOIN b USING (api) LEFT JOIN f USING (api)"
)
def capture_coverage(spark, d):
    """By API: milliseconds wanted, lost and recovered by backfills, gaps and the longest, backfills completed and failed, and failed ones whose time stays lost."""
    wanted, captured, backfills = _intervals(spark, d)
    covering = captured.unionByName(backfills.where("completed").select("api", "start", "end"))
    ms = lambda: F.unix_millis(F.col("end").cast("timestamp")) - F.unix_millis(F.col("start").cast("timestamp"))
    gaps = A.uncovered(wanted, covering, ["api"]).withColumn("ms", ms())
    w = wanted.groupBy("api").agg(F.sum(ms()).alias("wanted"))
    g = gaps.groupBy("api").agg(F.count("*").alias("gaps"), F.sum("ms").alias("lost"), F.max("ms").alias("max_gap"))
    r = A.uncovered(wanted, captured, ["api"]).groupBy("api").agg(F.sum(ms()).alias("uncaptured"))
    b = backfills.groupBy("api").agg(F.count_if("completed").alias("completed"), F.count_if(~F.col("completed")).alias("failed"))
    # a failed backfill's own time is one interval a number; what of it no cover covers within the hours is what stays lost
    own = backfills.where("not completed").select("api", "event_id", "start", "end")
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    spans = own.withColumn("day", F.explode(F.array_distinct(F.array(day("start"), day("end")))))
    lost = gaps.select("api", F.col("start").alias("s"), F.col("end").alias("e"), day("start").alias("day"))
    f = spans.join(lost, ["api", "day"]).where("s < end and e > start").groupBy("api").agg(F.countDistinct("event_id").alias("broken"))
    out = w.join(g, "api", "left").join(r, "api", "left").join(b, "api", "left").join(f, "api", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("api", "wanted", n("gaps"), n("lost"), n("max_gap"), (F.coalesce("uncaptured", F.lit(0)) - F.coalesce("lost", F.lit(0))).alias("recovered"), n("completed"), n("failed"), n("broken"))


_TTL, _UNTIL = 6 * 3600, 1706745600  # six hours; 2024-02-01


@query(
    f"""WITH RECURSIVE s AS (SELECT user_id AS stock, event_type AS cond, epoch_us(ts) / 1000000.0::DOUBLE AS pos, event_id % 3 <> 0 AS enters, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('signup', 'view', 'click')),
f(stock, n, conds, last, gone_at, pos, change, k) AS (SELECT DISTINCT stock, 0::BIGINT, []::VARCHAR[], NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR, 0::BIGINT FROM s UNION ALL
  SELECT stock, n, nc, CASE WHEN enters THEN pos ELSE last END, CASE WHEN gone THEN last + {_TTL} + 0.001 END, pos, CASE WHEN enters THEN CASE WHEN len(c) = 0 THEN 'ENTERED' ELSE 'KEPT' END WHEN list_contains(c, cond) THEN CASE WHEN len(nc) = 0 THEN 'LEFT' ELSE 'KEPT' END END, len(nc)
  FROM (SELECT *, CASE WHEN enters AND list_contains(c, cond) THEN c WHEN enters THEN list_append(c, cond) ELSE list_filter(c, lambda x: x <> cond) END AS nc FROM (SELECT s.*, f.last, len(f.conds) > 0 AND s.pos > f.last + {_TTL} AS gone, CASE WHEN len(f.conds) > 0 AND s.pos > f.last + {_TTL} THEN [] ELSE f.conds END AS c FROM f JOIN s ON s.stock = f.stock AND s.n = f.n + 1))),
z AS (SELECT stock, arg_max(conds, n) AS conds, arg_max(last, n) AS last FROM f GROUP BY 1)
SELECT stock, round(pos, 3) AS "at", change, k AS conditions FROM f WHERE change IS NOT NULL UNION ALL SELECT stock, round(gone_at, 3), 'EXPIRED', 0 FROM f WHERE gone_at IS NOT NULL UNION ALL SELECT stock, round(last + {_TTL} + 0.001, 3), 'EXPIRED', 0 FROM z WHERE len(conds) > 0 AND {_UNTIL} > last + {_TTL}"""
)
def candidate_changes(spark, d):
    """Candidates that enter, stay, leave, or expire in silence; the stream with timers gives the same rows (tests)."""
    e = table(spark, d, "events").where("event_type in ('signup', 'view', 'click')")
    s = e.select(F.col("user_id").alias("stock"), F.col("event_type").alias("condition"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_id") % 3 != 0).alias("enters"), "event_id")
    return timers.candidates(s, float(_TTL), float(_UNTIL)).withColumn("at", F.round("at", 3))
