"""Queries over event streams as tables: canonical events, ordering, hot state, hysteresis, dirty themes, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits
from ..sources.tables import table
from ..streaming import keyed
from .queries import query

_NEXT = """CASE WHEN disp <> 'LIVE' THEN state WHEN closed THEN CASE state WHEN 'CANDIDATE' THEN 'DISCARDED' ELSE 'CLOSED' END WHEN expired AND state = 'CANDIDATE' THEN 'DISCARDED' WHEN q IS NULL THEN state
WHEN state = 'CANDIDATE' THEN CASE WHEN q AND moment - coalesce(good, moment) >= 10 THEN 'ACTIVE' ELSE state END WHEN state = 'ACTIVE' THEN CASE WHEN NOT q AND moment - coalesce(below, moment) >= 60 THEN 'WEAKENING' ELSE state END
ELSE CASE WHEN q THEN CASE WHEN moment - weak <= 600 THEN 'ACTIVE' ELSE 'CLOSED' END WHEN moment - coalesce(weak_below, moment) >= 600 THEN 'CLOSED' ELSE state END END"""
_HYST = f"""s AS (SELECT user_id % 20 AS key, ts::DATE AS day, event_id AS arrival, event_id - CASE WHEN event_id % 7 = 0 THEN 400 ELSE 0 END AS seq, CASE WHEN event_id % 29 = 0 THEN event_id - 400 ELSE event_id END // 20 AS id, (floor(epoch(ts)) - CASE WHEN event_id % 11 = 0 THEN 40000 ELSE 0 END) / 40.0::DOUBLE AS moment,
  CASE WHEN event_type <> 'error' THEN value > 4 END AS q, event_id % 97 = 0 AS closed, event_id % 53 = 0 AS expired, row_number() OVER (PARTITION BY user_id % 20, ts::DATE ORDER BY event_id) AS n FROM events),
f AS (SELECT DISTINCT key, day, 0::BIGINT AS n, NULL::BIGINT AS arrival, 'CANDIDATE' AS state, NULL::DOUBLE AS good, NULL::DOUBLE AS below, NULL::DOUBLE AS weak, NULL::DOUBLE AS weak_below, NULL::BIGINT AS last_seq, NULL::DOUBLE AS last_at, NULL::BIGINT AS last_id, NULL::VARCHAR AS disposition FROM s
UNION ALL SELECT key, day, n, arrival, new_state, CASE WHEN disp <> 'LIVE' THEN good WHEN new_state = state AND state = 'CANDIDATE' AND q THEN coalesce(good, moment) END,
  CASE WHEN disp <> 'LIVE' THEN below WHEN new_state = state AND state = 'ACTIVE' AND NOT q THEN coalesce(below, moment) END, CASE WHEN disp <> 'LIVE' OR new_state = state THEN weak WHEN new_state = 'WEAKENING' THEN moment END,
  CASE WHEN disp <> 'LIVE' THEN weak_below WHEN new_state = state AND state = 'WEAKENING' AND NOT q THEN coalesce(weak_below, moment) WHEN new_state <> state AND new_state = 'WEAKENING' THEN moment END,
  CASE WHEN disp IN ('LIVE', 'TERMINAL') THEN seq ELSE last_seq END, CASE WHEN disp IN ('LIVE', 'TERMINAL') THEN moment ELSE last_at END, CASE WHEN disp IN ('LIVE', 'TERMINAL') THEN id ELSE last_id END,
  CASE WHEN disp <> 'LIVE' THEN disp WHEN new_state <> state THEN 'TRANSITIONED' ELSE 'NO_TRANSITION' END
  FROM (SELECT *, {_NEXT} AS new_state FROM (SELECT f.* EXCLUDE (n, arrival), s.n, s.arrival, s.seq, s.id, s.moment, s.q, s.closed, s.expired, CASE WHEN s.id = f.last_id THEN 'DUPLICATE' WHEN s.seq <= f.last_seq THEN 'STALE_SEQUENCE' WHEN s.moment < f.last_at THEN 'STALE_TIME' WHEN f.state IN ('CLOSED', 'DISCARDED') THEN 'TERMINAL' ELSE 'LIVE' END AS disp FROM f JOIN s ON s.key = f.key AND s.day = f.day AND s.n = f.n + 1)))"""


@query(f"WITH RECURSIVE {_HYST} SELECT key, day, arrival, disposition, state FROM f WHERE n > 0")
def hysteresis_fold(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    s = e.select(
        (F.col("user_id") % 20).alias("key"), F.to_date("ts").alias("day"), i.alias("arrival"), (i - F.when(i % 7 == 0, 400).otherwise(0)).alias("sequence"), F.floor(F.when(i % 29 == 0, i - 400).otherwise(i) / 20).alias("input_id"),
        ((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.when(i % 11 == 0, 40000).otherwise(0)) / 40.0).alias("at"), F.when(F.col("event_type") != "error", F.col("value") > 4).alias("qualifies"), (i % 97 == 0).alias("market_closed"), (i % 53 == 0).alias("expired"),
    )
    return keyed.hysteresis(s, ["key", "day"], "key long, day date")


def _updates(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(F.to_date("ts").alias("day"), (F.col("user_id") % 15).alias("stock_id"), i.alias("arrival"), F.floor(i / 2 - F.when(i % 13 == 0, 3).otherwise(0)).cast("long").alias("message_id"), F.col("event_type").alias("source"), (i - F.when(i % 5 == 0, 600).otherwise(0)).alias("sequence"), (i - F.when(i % 17 == 0, 900).otherwise(0)).alias("received"), F.round("value").cast("long").alias("occurred"))


@query(
    "WITH u AS (SELECT ts::DATE AS day, user_id % 15 AS stock_id, event_id AS arrival, floor(event_id / 2 - CASE WHEN event_id % 13 = 0 THEN 3 ELSE 0 END)::BIGINT AS message_id, event_type AS source, event_id - CASE WHEN event_id % 5 = 0 THEN 600 ELSE 0 END AS sequence, event_id - CASE WHEN event_id % 17 = 0 THEN 900 ELSE 0 END AS received, floor(value + 0.5)::BIGINT AS occurred FROM events), "
    "a AS (SELECT *, row_number() OVER (PARTITION BY day, stock_id, message_id ORDER BY arrival) > 1 AS again FROM u), c AS (SELECT *, max(CASE WHEN NOT again THEN sequence END) OVER b AS cursor FROM a WINDOW b AS (PARTITION BY day, stock_id, source ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "h AS (SELECT *, NOT again AND (cursor IS NULL OR sequence > cursor) AS ahead FROM c), r AS (SELECT *, max(CASE WHEN ahead THEN received END) OVER b AS receipt FROM h WINDOW b AS (PARTITION BY day, stock_id, source ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "g AS (SELECT *, ahead AND coalesce(received < receipt, FALSE) AS behind, (occurred, received, source, sequence, message_id) AS o FROM r), t AS (SELECT *, max(CASE WHEN ahead AND NOT behind THEN o END) OVER (PARTITION BY day, stock_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM g), "
    "x AS (SELECT *, CASE WHEN again THEN 'DUPLICATE' WHEN NOT ahead THEN 'STALE_SOURCE_SEQUENCE' WHEN behind THEN 'STALE_RECEIVED_AT' WHEN top IS NOT NULL AND o <= top THEN 'STALE_OBSERVATION' ELSE 'APPLIED' END AS disposition FROM t) "
    "SELECT day, stock_id, arrival, disposition, count(*) FILTER (disposition = 'APPLIED') OVER (PARTITION BY day, stock_id ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS version FROM x"
)
def hot_state_dispositions(spark, d):
    return keyed.hot_state(_updates(spark, d)).select("day", "stock_id", "arrival", "disposition", "version")


# one step a tick: what was seen, each lane's last accepted one and the latest observation are lists and values of the state
_FENCE = """e AS (SELECT user_id % 15 AS key, event_id AS arrival, date_diff('day', DATE '2024-01-01', ts::DATE) AS session, event_id // 3 AS identity, event_id % 2 AS payload, event_type AS lane, event_id - CASE WHEN event_id % 5 = 0 THEN 300 ELSE 0 END AS spot, event_id - CASE WHEN event_id % 17 = 0 THEN 900 ELSE 0 END AS received, event_id // 50 AS occurred, event_type = 'view' AS live,
  row_number() OVER (PARTITION BY user_id % 15 ORDER BY event_id) AS n FROM events),
f(key, n, arrival, session, seen, lanes, latest, disposition) AS (SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::STRUCT(i BIGINT, p BIGINT)[], []::STRUCT(l VARCHAR, s BIGINT, r BIGINT)[], NULL::STRUCT(o BIGINT, v BOOLEAN, r BIGINT), NULL::VARCHAR FROM e
  UNION ALL SELECT key, n, arrival, now, CASE WHEN d = 'ACCEPTED' THEN list_append(seen, {'i': identity, 'p': payload}) ELSE seen END, CASE WHEN d = 'ACCEPTED' THEN list_append(list_filter(open_lanes, lambda x: x.l <> lane), {'l': lane, 's': spot, 'r': received}) ELSE open_lanes END, CASE WHEN d = 'ACCEPTED' THEN {'o': occurred, 'v': live, 'r': received} ELSE latest END, d
  FROM (SELECT *, CASE WHEN session < now THEN 'OLD_SESSION' WHEN len(list_filter(seen, lambda x: x.i = identity)) > 0 THEN CASE WHEN list_filter(seen, lambda x: x.i = identity)[1].p = payload THEN 'DUPLICATE' ELSE 'CONFLICT' END
      WHEN len(list_filter(open_lanes, lambda x: x.l = lane AND (spot <= x.s OR received < x.r))) > 0 THEN 'OUT_OF_ORDER'
      WHEN latest IS NOT NULL AND (occurred < latest.o OR occurred = latest.o AND (latest.v AND NOT live OR latest.v = live AND received < latest.r)) THEN 'OLD_OBSERVATION' ELSE 'ACCEPTED' END AS d
    FROM (SELECT e.*, f.seen, f.latest, greatest(coalesce(f.session, e.session), e.session) AS now, CASE WHEN f.session IS NULL OR e.session > f.session THEN [] ELSE f.lanes END AS open_lanes FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)))"""


@query(f"WITH RECURSIVE {_FENCE} SELECT key, arrival, disposition FROM f WHERE n > 0")
def order_fence(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(
        (F.col("user_id") % 15).alias("key"), i.alias("arrival"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("session"), F.floor(i / 3).alias("identity"), (i % 2).alias("payload"), F.col("event_type").alias("lane"), (i - F.when(i % 5 == 0, 300).otherwise(0)).alias("position"),
        (i - F.when(i % 17 == 0, 900).otherwise(0)).alias("received"), F.floor(i / 50).alias("occurred"), (F.col("event_type") == "view").alias("realtime"),
    )
    return keyed.order_fence(e)


@query(r"""SELECT event_id, 'mkt_' || substr(sha256('{"at":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","stock":' || user_id || ',"type":"' || CASE event_type WHEN 'view' THEN 'trade' WHEN 'signup' THEN 'condition' ELSE 'snapshot' END || '"}'), 1, 26) AS identity, CASE event_type WHEN 'view' THEN 'trade' WHEN 'signup' THEN 'condition' ELSE 'snapshot' END AS kind, nullif(try_cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT), 0) AS amount, CASE WHEN value - try_cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) / 10.0::DOUBLE > 0 THEN round(value - try_cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) / 10.0::DOUBLE, 6) END AS base FROM events WHERE event_type NOT IN ('error')""")
def canonical_events(spark, d):
    e = table(spark, d, "events").where("event_type not in ('error')").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))
    kind = F.when(F.col("event_type") == "view", "trade").when(F.col("event_type") == "signup", "condition").otherwise("snapshot")
    natural = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("user_id").alias("stock"), kind.alias("type")))
    base = F.col("value") - F.col("k") / 10.0
    return e.select("event_id", F.concat(F.lit("mkt_"), F.substring(F.sha2(natural, 256), 1, 26)).alias("identity"), kind.alias("kind"), F.nullif("k", F.lit(0)).alias("amount"), F.when(base > 0, F.round(base, 6)).alias("base"))


@query("WITH c AS (SELECT user_id AS stock_id, max(ts) AS changed FROM events WHERE ts > TIMESTAMP '2024-01-30' GROUP BY 1), t AS (SELECT p_brand AS theme_id, p_partkey AS stock_id FROM part) SELECT theme_id, max(changed) AS as_of, count(*) AS changed_stocks FROM c JOIN t USING (stock_id) GROUP BY 1")
def dirty_themes(spark, d):
    c = table(spark, d, "events").where(F.col("ts") > F.lit("2024-01-30").cast("timestamp_ntz")).groupBy(F.col("user_id").alias("stock_id")).agg(F.max("ts").alias("changed"))
    t = table(spark, d, "part").select(F.col("p_brand").alias("theme_id"), F.col("p_partkey").alias("stock_id"))
    return c.join(t, "stock_id").groupBy("theme_id").agg(F.max("changed").alias("as_of"), F.count("*").alias("changed_stocks"))


@query("WITH d AS (SELECT DISTINCT p_brand AS theme_id FROM part JOIN events ON user_id = p_partkey WHERE ts > TIMESTAMP '2024-01-30'), m AS (SELECT p_brand AS theme_id, p_partkey AS stock_id FROM part WHERE p_brand IN (SELECT theme_id FROM d)), h AS (SELECT user_id AS stock_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1) SELECT theme_id, count(*) AS total, count(value) AS observed, round(avg(value), 6) AS mean FROM m LEFT JOIN h USING (stock_id) GROUP BY 1")
def dirty_drain(spark, d):
    m = table(spark, d, "part").select(F.col("p_brand").alias("theme_id"), F.col("p_partkey").alias("stock_id"))
    hot = table(spark, d, "events").groupBy(F.col("user_id").alias("stock_id")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return m.join(dirty_themes(spark, d).select("theme_id"), "theme_id", "left_semi").join(hot, "stock_id", "left").groupBy("theme_id").agg(F.count("*").alias("total"), F.count("value").alias("observed"), F.round(F.avg("value"), 6).alias("mean"))


@query("WITH a(f, t) AS (VALUES ('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('click', 'view')), s AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, event_type AS t FROM events) SELECT f, t, count(*) AS violations FROM s WHERE f IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.f = s.f AND a.t = s.t) GROUP BY 1, 2")
def lifecycle_violations(spark, d):
    """Moves between states that the table of allowed ones (constant size) doesn't hold."""
    from pyspark.sql import Window

    allowed = spark.createDataFrame([("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view")], "f string, t string")
    s = table(spark, d, "events").select(F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("f"), F.col("event_type").alias("t"))
    return s.where("f is not null").join(F.broadcast(allowed), ["f", "t"], "left_anti").groupBy("f", "t").agg(F.count("*").alias("violations"))


@query("WITH n AS (SELECT max(ts) AS now FROM events), c AS (SELECT user_id % 40 AS stock, event_type, max(ts) AS last, arg_max(event_id % 3 = 0, (ts, event_id)) AS gone FROM events WHERE event_type IN ('signup', 'view', 'click') GROUP BY 1, 2) SELECT stock, event_type, last FROM c, n WHERE NOT gone AND now - last <= INTERVAL 48 HOUR")
def candidate_set(spark, d):
    """Per stock and condition the last signal: an exit (every third event) removes, and silence beyond the time to live prunes."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    c = e.where("event_type in ('signup', 'view', 'click')").groupBy((F.col("user_id") % 40).alias("stock"), "event_type").agg(F.max("ts").alias("last"), F.max_by(F.col("event_id") % 3 == 0, F.struct("ts", "event_id")).alias("gone"))
    return c.crossJoin(F.broadcast(now)).where("not gone and now - last <= interval 48 hours").select("stock", "event_type", "last")


@query("WITH x AS (SELECT event_type, ts::DATE AS day, event_id, ts, value, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE hour(ts) < 15) SELECT event_type, day, event_id, ts, round(value, 6) AS value FROM x WHERE n = 1")
def latest_snapshot_of_day(spark, d):
    e = table(spark, d, "events").where(F.hour("ts") < 15)
    g = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max(F.struct("ts", "event_id", "value")).alias("x"))
    return g.select("event_type", "day", "x.event_id", "x.ts", F.round("x.value", 6).alias("value"))


@query("SELECT event_id, event_type, ts FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-10 09:00:00' AND ts < TIMESTAMP '2024-01-12 15:30:01'")
def tick_filter(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").where(F.col("event_type").isin("view", "click") & (ts >= F.lit("2024-01-10 09:00:00").cast("timestamp_ntz")) & (ts < F.lit("2024-01-12 15:30:01").cast("timestamp_ntz"))).select("event_id", "event_type", "ts")


@query("WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS before, lag(event_id) OVER (ORDER BY event_id) AS previous FROM events), m AS (SELECT event_type, CASE WHEN before IS NOT NULL THEN greatest(epoch_us(ts) // 1000 - epoch_us(before) // 1000, 0) END AS gap, ts < before AS back, event_id <> previous + 1 AS hole, sha256(props) <> sha256('{\"k\": ' || regexp_extract(props, '([0-9]+)', 1) || '}') AS torn FROM g) SELECT event_type, count(*) AS n, count(*) FILTER (back) AS regressions, count(*) FILTER (hole) AS holes, count(*) FILTER (torn) AS torn, max(gap) AS max_gap, quantile_disc(gap, 0.5) AS p50, quantile_disc(gap, 0.95) AS p95, quantile_disc(gap, 0.99) AS p99 FROM m GROUP BY 1")
def tick_quality(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "props")
    # the row before by number: a join on the number, no window over all rows
    numbers = e.select((F.col("seq") + 1).alias("seq"), F.lit(True).alias("follows"))
    e = audits.since_last(e).join(numbers, "seq", "left")
    ms = lambda c: F.floor(F.col(c) / 1000)
    least = e.agg(F.min("seq").alias("least"))
    e = e.crossJoin(F.broadcast(least)).withColumn("hole", F.col("follows").isNull() & (F.col("seq") != F.col("least")))
    e = e.withColumn("gap", F.when(F.col("before").isNotNull(), F.greatest(ms("at") - ms("before"), F.lit(0))))
    torn = F.sha2("props", 256) != F.sha2(F.concat(F.lit('{"k": '), F.regexp_extract("props", "([0-9]+)", 1), F.lit("}")), 256)
    g = e.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("at") < F.col("before")).alias("regressions"), F.count_if("hole").alias("holes"), F.count_if(torn).alias("torn"), F.max("gap").alias("max_gap"))
    return g.join(audits.nearest_ranks(e, "kind", "gap", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "kind", "left").withColumnRenamed("kind", "event_type")


@query(
    "WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS last, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1), s AS (SELECT p_brand AS theme_id, CASE WHEN last IS NULL THEN 'MISSING' WHEN v IS NULL OR v < 5 THEN 'INCOMPLETE' WHEN now - last <= INTERVAL 6 HOUR THEN 'FRESH' WHEN now - last <= INTERVAL 12 HOUR THEN 'LOW_CONFIDENCE' ELSE 'STALE' END AS status FROM part LEFT JOIN l ON user_id = p_partkey, n) "
    "SELECT theme_id, count(*) AS requested, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ("MISSING", "INCOMPLETE", "FRESH", "LOW_CONFIDENCE", "STALE")) + " FROM s GROUP BY 1"
)
def freshness_states(spark, d):
    """What is requested against what came: the five states add up to the stocks requested."""
    e = table(spark, d, "events")
    last = e.groupBy(F.col("user_id").alias("p_partkey")).agg(F.max("ts").alias("last"), F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    now = e.agg(F.max("ts").alias("now"))
    age = F.col("now") - F.col("last")
    hours = lambda n: F.expr(f"INTERVAL {n} HOUR")
    status = F.when(F.col("last").isNull(), "MISSING").when(F.col("v").isNull() | (F.col("v") < 5), "INCOMPLETE").when(age <= hours(6), "FRESH").when(age <= hours(12), "LOW_CONFIDENCE").otherwise("STALE")
    s = table(spark, d, "part").join(last, "p_partkey", "left").crossJoin(F.broadcast(now)).select(F.col("p_brand").alias("theme_id"), status.alias("status"))
    return s.groupBy("theme_id").agg(F.count("*").alias("requested"), *[F.count_if(F.col("status") == x).alias(x.lower()) for x in ("MISSING", "INCOMPLETE", "FRESH", "LOW_CONFIDENCE", "STALE")])
