"""Queries that link catalysts, news and cases: orders as catalysts, events as news."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import linking as L
from ..sources.tables import table
from .queries import _DAILY, query, r6


@query("WITH x AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_orderstatus AS stage, o_orderpriority AS type, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 4 END AS project, floor(o_totalprice / 50000)::BIGINT AS signature, substr('the order of the day is here', 1, 18 + (o_custkey % 10)::INTEGER) AS text FROM orders) SELECT a.id AS a, b.id AS b FROM x a JOIN x b USING (day, stage, type) WHERE a.id < b.id AND (a.project = b.project OR a.signature = b.signature AND (contains(a.text, b.text) OR contains(b.text, a.text)) AND least(length(a.text), length(b.text)) >= 0.75 * greatest(length(a.text), length(b.text)))")
def possible_duplicates(spark, d):
    o, c = table(spark, d, "orders"), F.col("o_custkey")
    text = F.substring(F.lit("the order of the day is here"), F.lit(1), (18 + c % 10).cast("int"))
    x = o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("type"), F.when(F.col("o_orderkey") % 3 == 0, c % 4).alias("project"), F.floor(F.col("o_totalprice") / 50000).alias("signature"), text.alias("text"))
    return L.possible_duplicates(x, ["day", "stage", "type"])


@query("WITH n AS (SELECT event_id, event_type <> 'error' AS featured, CASE event_id % 5 WHEN 0 THEN 'ftp://x' WHEN 1 THEN NULL ELSE 'https://x/' || event_id END AS url, user_id % 4 <> 0 AS listed, ts FROM events), r AS (SELECT event_id, CASE WHEN NOT featured THEN 'NOT_FEATURED' WHEN url IS NULL OR NOT regexp_matches(url, '^https?://') THEN 'INVALID_URL' WHEN NOT listed THEN 'NO_LISTED_STOCK' WHEN ts > TIMESTAMP '2024-01-25' THEN 'FUTURE' WHEN ts < TIMESTAMP '2024-01-05' THEN 'BEFORE_WINDOW' END AS reason FROM n) SELECT coalesce(reason, 'TAKEN') AS reason, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY 1")
def news_rejections(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    url = F.when(i % 5 == 0, "ftp://x").when(i % 5 == 1, None).otherwise(F.concat(F.lit("https://x/"), i.cast("string")))
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    r = e.select("event_id", L.rejection(F.col("event_type") != "error", url, F.col("user_id") % 4 != 0, F.col("ts"), day("2024-01-05"), day("2024-01-25")).alias("reason"))
    return r.groupBy(F.coalesce("reason", F.lit("TAKEN")).alias("reason")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT event_id, ts FROM (SELECT *, row_number() OVER (ORDER BY coalesce(CASE WHEN event_id % 6 <> 0 THEN ts END, ts - INTERVAL 1 DAY) DESC, event_id DESC) AS n FROM events WHERE (user_id IN (3, 5, 8) OR lower(event_type) LIKE '%purch%') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-28') WHERE n <= 200")
def news_search(spark, d):
    """The 200 newest that name a stock or hold the keyword; what has no publication time goes by that of retrieval."""
    e = table(spark, d, "events").where((F.col("user_id").isin(3, 5, 8) | F.contains(F.lower("event_type"), F.lit("purch"))) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-28").cast("timestamp_ntz")))
    at = F.coalesce(F.when(F.col("event_id") % 6 != 0, F.col("ts")), F.col("ts") - F.expr("INTERVAL 1 DAY"))
    return e.orderBy(at.desc(), F.col("event_id").desc()).limit(200).select("event_id", "ts")


_NEWS = """news AS (SELECT event_id AS news_id, CASE WHEN event_id % 3 = 0 THEN [user_id % 7] ELSE [] END AS theme_ids, [user_id, (user_id + event_id) % 150] AS stocks, [event_type] AS own, ts AS published FROM events WHERE event_type <> 'error'),
ctx AS (SELECT user_id % 7 AS theme_id, coalesce(list_distinct(list(user_id) FILTER (user_id % 10 = 0)), []) AS leaders, coalesce(list_distinct(list(user_id) FILTER (user_id % 10 IN (1, 2))), []) AS related, coalesce(list_distinct(list(event_type) FILTER (user_id % 5 = 0 AND event_type <> 'view')), []) AS entities, max(ts) - INTERVAL 240 HOUR AS since, max(ts) - INTERVAL 48 HOUR AS decision FROM events GROUP BY 1),
p AS (SELECT news_id, unnest(theme_ids) AS theme_id FROM news UNION SELECT news_id, theme_id FROM (SELECT news_id, unnest(stocks) AS stock FROM news) JOIN (SELECT theme_id, unnest(list_distinct(list_concat(leaders, related))) AS stock FROM ctx) USING (stock)),
rel AS (SELECT news_id, theme_id, published, decision, list_has_any(stocks, leaders) AS lead, list_has_any(stocks, related) AS rel, published BETWEEN since AND decision AS timely, round(least(CASE WHEN list_contains(theme_ids, theme_id) THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN list_has_any(stocks, leaders) THEN 0.30::DOUBLE WHEN list_has_any(stocks, related) THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN published BETWEEN since AND decision THEN 0.20::DOUBLE ELSE 0 END
  + CASE WHEN len(list_distinct(list_intersect(stocks, list_concat(leaders, related)))) >= 2 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN list_has_any(own, entities) THEN 0.05::DOUBLE ELSE 0 END, 1.0), 6) AS score FROM p JOIN news USING (news_id) JOIN ctx USING (theme_id)),
scored AS (SELECT news_id, theme_id, score, score >= 0.35 AND (lead OR rel OR timely) AND published <= decision AS counts FROM rel)"""


def _relevance(spark, d):
    e, u = table(spark, d, "events"), F.col("user_id")
    news = e.where("event_type <> 'error'").select(F.col("event_id").alias("news_id"), F.when(F.col("event_id") % 3 == 0, F.array(u % 7)).otherwise(F.array().cast("array<bigint>")).alias("theme_ids"), F.array(u, (u + F.col("event_id")) % 150).alias("stocks"), F.array("event_type").alias("entities"), F.col("ts").alias("published"))
    ctx = e.groupBy((u % 7).alias("theme_id")).agg(F.collect_set(F.when(u % 10 == 0, u)).alias("leaders"), F.collect_set(F.when((u % 10).isin(1, 2), u)).alias("related"), F.collect_set(F.when((u % 5 == 0) & (F.col("event_type") != "view"), F.col("event_type"))).alias("entities"), (F.max("ts") - F.expr("INTERVAL 240 HOUR")).alias("since"), (F.max("ts") - F.expr("INTERVAL 48 HOUR")).alias("decision"))
    return L.relevance(news, ctx)


@query(f"WITH {_NEWS} SELECT * FROM scored")
def news_relevance(spark, d):
    return _relevance(spark, d)


@query(f"WITH {_NEWS}, r AS (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY score DESC, news_id) AS place FROM scored WHERE counts) SELECT theme_id, place, news_id, score FROM r WHERE place <= 10")
def theme_to_news(spark, d):
    w = Window.partitionBy("theme_id").orderBy(F.col("score").desc(), "news_id")
    return _relevance(spark, d).where("counts").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10").select("theme_id", "place", "news_id", "score")


@query(f"WITH {_NEWS}, r AS (SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY score DESC, theme_id) AS place FROM scored WHERE counts) SELECT news_id, theme_id, score FROM r WHERE place = 1")
def news_to_event(spark, d):
    w = Window.partitionBy("news_id").orderBy(F.col("score").desc(), "theme_id")
    return _relevance(spark, d).where("counts").withColumn("place", F.row_number().over(w)).where("place = 1").select("news_id", "theme_id", "score")


@query("SELECT user_id, count(DISTINCT lower(trim(event_type))) AS publishers, max(ts) AS newest, count(*) AS items FROM events WHERE value > 5 GROUP BY 1")
def evidence_summary(spark, d):
    return table(spark, d, "events").where("value > 5").groupBy("user_id").agg(F.countDistinct(F.lower(F.trim("event_type"))).alias("publishers"), F.max("ts").alias("newest"), F.count("*").alias("items"))


_OUT = f"{_DAILY}, fw AS (SELECT stock_id, day, " + ", ".join(f"lead(close, {h}) OVER w / close * 100 - 100 AS h{h}" for h in (1, 5, 20)) + " FROM daily WINDOW w AS (PARTITION BY stock_id ORDER BY day)), last_day AS (SELECT max(day) AS last FROM daily)"


@query(
    f"WITH {_OUT}, m AS (SELECT l_orderkey AS case_id, h.h, CASE h.h WHEN 1 THEN h1 WHEN 5 THEN h5 ELSE h20 END AS ret, day IS NOT NULL AS priced FROM lineitem LEFT JOIN fw ON stock_id = l_partkey AND day = l_shipdate::DATE AND l_linenumber % 7 <> 0, (VALUES (1), (5), (20)) h(h)) "
    "SELECT case_id, h::BIGINT AS horizon, count(ret) AS members, round(avg(ret), 6) AS outcome, CASE WHEN count(ret) > 0 THEN 'OBSERVED' WHEN bool_or(priced) THEN 'PENDING' ELSE 'UNAVAILABLE' END AS status FROM m GROUP BY 1, 2"
)
def basket_outcomes(spark, d):
    """Per case and horizon the mean over priced members: OBSERVED, PENDING (not reached) or UNAVAILABLE (none priced)."""
    from ..operators import timeseries
    from ..sources.tables import daily_prices

    fw = timeseries.forward_returns(daily_prices(spark, d))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("stock_id"), F.to_date("l_shipdate").alias("day"), (F.col("l_linenumber") % 7 != 0).alias("known"))
    m = l.join(fw.withColumn("priced", F.lit(True)), ["stock_id", "day"], "left").withColumn("priced", F.coalesce("priced", F.lit(False)) & F.col("known"))
    h = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("horizon"), F.when(F.col("priced"), F.col(f"fwd_{n}")).alias("ret")) for n in (1, 5, 20)])).alias("x")
    g = m.select("case_id", "priced", h).select("case_id", "priced", "x.*").groupBy("case_id", "horizon").agg(F.count("ret").alias("members"), r6(F.avg("ret")).alias("outcome"), F.max("priced").alias("any"))
    return g.select("case_id", "horizon", "members", "outcome", F.when(F.col("members") > 0, "OBSERVED").when(F.col("any"), "PENDING").otherwise("UNAVAILABLE").alias("status"))


@query("SELECT o_orderkey, 'evt_hist_' || o_orderpriority || '_' || substr(sha256(o_orderpriority || '|' || o_orderkey), 1, 16) AS case_id FROM orders")
def case_ids(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("evt_hist_"), p, F.lit("_"), F.substring(F.sha2(F.concat(p, F.lit("|"), F.col("o_orderkey").cast("string")), 256), 1, 16)).alias("case_id"))


@query("SELECT l_orderkey, sha256(l_orderkey || '|' || string_agg(DISTINCT lower(l_returnflag || l_linestatus), '|' ORDER BY lower(l_returnflag || l_linestatus))) AS catalyst_key FROM lineitem GROUP BY 1")
def catalyst_keys(spark, d):
    names = F.array_join(F.sort_array(F.collect_set(F.lower(F.concat("l_returnflag", "l_linestatus")))), "|")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(names.alias("names")).select("l_orderkey", F.sha2(F.concat_ws("|", F.col("l_orderkey").cast("string"), "names"), 256).alias("catalyst_key"))


@query("WITH r AS (SELECT user_id AS key, ts AS at_, event_id AS id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_hour FROM events) SELECT id, CASE WHEN at_ < last + INTERVAL 20 MINUTE THEN 'COOLDOWN' WHEN in_hour > 1 THEN 'QUOTA' ELSE 'GRANTED' END AS status FROM r")
def supplemental_gate(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"))
    return L.quota(e, "20 minutes", 1).select("id", "status")


_BLIND = "a AS (SELECT o_orderkey AS k, o_orderpriority AS p, CASE WHEN o_custkey % 3 = 0 THEN '5-LOW' ELSE '1-URGENT' END AS alt FROM orders WHERE o_totalprice > 20000), b AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 4 = 0 THEN '5-LOW' ELSE o_orderpriority END AS p, '2-HIGH' AS alt FROM orders WHERE o_totalprice < 480000)"


@query(f"WITH {_BLIND} SELECT coalesce(a.k, b.k) AS k, a.p AS first, b.p AS second, CASE WHEN a.p IS NULL OR b.p IS NULL THEN 'MISSING' WHEN a.p = b.p THEN 'STRICT' WHEN list_has_any([a.p, a.alt], [b.p, b.alt]) THEN 'LENIENT' ELSE 'DISAGREE' END AS status FROM a FULL JOIN b ON a.k = b.k")
def blind_review(spark, d):
    o, c, k = table(spark, d, "orders"), F.col("o_custkey"), F.col("o_orderkey")
    a = o.where("o_totalprice > 20000").select(k.alias("k"), F.col("o_orderpriority").alias("primary"), F.when(c % 3 == 0, "5-LOW").otherwise("1-URGENT").alias("alternative"))
    b = o.where("o_totalprice < 480000").select(k.alias("k"), F.when(c % 4 == 0, "5-LOW").otherwise(F.col("o_orderpriority")).alias("primary"), F.lit("2-HIGH").alias("alternative"))
    return L.agreement(a, b, "k")


@query("WITH s AS (SELECT l_orderkey AS k, l_linenumber AS i, l_returnflag AS q FROM lineitem WHERE l_quantity > 2), r AS (SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN l_tax > 0.07 THEN 'X' ELSE l_returnflag END AS q FROM lineitem WHERE l_quantity < 49), s1 AS (SELECT k, i, min(q) AS q FROM s GROUP BY 1, 2), r1 AS (SELECT k, i, min(q) AS q FROM r GROUP BY 1, 2) SELECT CASE WHEN s1.k IS NULL THEN 'READER_ONLY' WHEN r1.k IS NULL THEN 'SOURCE_ONLY' WHEN s1.q IS NOT DISTINCT FROM r1.q THEN 'SAME' ELSE 'DIFFERENT' END AS status, count(*) AS n FROM s1 FULL JOIN r1 ON s1.k = r1.k AND s1.i = r1.i GROUP BY 1")
def two_path_check(spark, d):
    l = table(spark, d, "lineitem")
    keyed = lambda df, q: df.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")).agg(F.min(q).alias("q"))
    s = keyed(l.where("l_quantity > 2"), F.col("l_returnflag")).withColumnRenamed("q", "sq").withColumn("s", F.lit(True))
    r = keyed(l.where("l_quantity < 49"), F.when(F.col("l_tax") > 0.07, "X").otherwise(F.col("l_returnflag"))).withColumnRenamed("q", "rq").withColumn("r", F.lit(True))
    status = F.when(F.col("s").isNull(), "READER_ONLY").when(F.col("r").isNull(), "SOURCE_ONLY").when(F.col("sq").eqNullSafe(F.col("rq")), "SAME").otherwise("DIFFERENT")
    return s.join(r, ["k", "i"], "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS grp, count(*) AS n, round(avg(CASE WHEN value IS NOT NULL AND user_id % 3 <> 0 THEN (value > 10)::INT END), 6) AS type_accuracy, round(avg(CASE WHEN user_id % 4 <> 0 THEN (event_id % 9 > 0)::INT END), 6) AS date_accuracy, count(*) FILTER (user_id % 4 = 0) AS without_date FROM events GROUP BY 1")
def planner_scoring(spark, d):
    u = F.col("user_id")
    right = lambda has, ok: F.round(F.avg(F.when(has, ok.cast("int"))), 6)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("grp")).agg(F.count("*").alias("n"), right(F.col("value").isNotNull() & (u % 3 != 0), F.col("value") > 10).alias("type_accuracy"), right(u % 4 != 0, F.col("event_id") % 9 > 0).alias("date_accuracy"), F.count_if(u % 4 == 0).alias("without_date"))


@query("WITH i AS (SELECT unnest([CASE WHEN l_discount = 0 THEN 'NO_DISCOUNT' END, CASE WHEN l_tax = 0 THEN 'NO_TAX' END, CASE WHEN l_quantity < 2 THEN 'SMALL' END]) AS issue, l_linestatus AS component, l_partkey FROM lineitem) SELECT issue, component, count(*) AS n, count(DISTINCT l_partkey) AS stocks FROM i WHERE issue IS NOT NULL GROUP BY 1, 2")
def import_quality(spark, d):
    l = table(spark, d, "lineitem")
    issue = F.explode(F.array_compact(F.array(F.when(F.col("l_discount") == 0, "NO_DISCOUNT"), F.when(F.col("l_tax") == 0, "NO_TAX"), F.when(F.col("l_quantity") < 2, "SMALL"))))
    return l.select(issue.alias("issue"), F.col("l_linestatus").alias("component"), "l_partkey").groupBy("issue", "component").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("stocks"))


@query("WITH c AS (SELECT event_type, max(ts) FILTER (ts < TIMESTAMP '2024-01-20') AS cursor FROM events GROUP BY 1) SELECT event_type, count(*) AS new_items, max(ts) AS next_cursor FROM (SELECT event_type, CASE WHEN event_id % 50 <> 0 THEN ts END AS ts FROM events) e JOIN c USING (event_type) WHERE ts IS NULL OR ts > cursor GROUP BY 1")
def polling_cursor(spark, d):
    e = table(spark, d, "events")
    c = e.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).groupBy("event_type").agg(F.max("ts").alias("cursor"))
    n = e.select("event_type", F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("ts")).join(F.broadcast(c), "event_type")
    return n.where("ts is null or ts > cursor").groupBy("event_type").agg(F.count("*").alias("new_items"), F.max("ts").alias("next_cursor"))


# users as themes, their views and clicks of ten days as news; a third of the themes have an earlier decision
_EVIDENCE = """th AS (SELECT user_id AS theme_id, min(ts) FILTER (event_type = 'signup') AS first_signup, max(ts) AS last FROM events GROUP BY 1),
ctx AS (SELECT theme_id, coalesce(first_signup, last - INTERVAL 5 MINUTE) AS activated_at, last AS now, CASE WHEN theme_id % 2 = 0 THEN ['cat_' || substr(sha256(theme_id || '|' || 'e1'), 1, 24)] ELSE [] END AS known, theme_id % 7 = 0 AS degraded, CASE WHEN theme_id % 11 = 0 THEN 'closed ' || theme_id END AS after_close FROM th),
evi AS (SELECT user_id AS theme_id, event_id AS news_id, ['Alpha', ' alpha', 'Beta', ' '][event_id % 4 + 1] AS publisher, 'Title  ' || event_id % 3 AS title, 's' || event_id AS summary, CASE WHEN event_id % 6 = 0 THEN [] ELSE ['e' || event_id % 2] END AS entities FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND (user_id % 4 > 0 OR event_id % 5 = 0)),
old AS (SELECT theme_id, ['SEARCHING', 'SINGLE_SOURCE', 'MULTI_SOURCE_CONFIRMED', 'NO_NEW_CATALYST'][theme_id // 3 % 4 + 1] AS status, 'old' || theme_id AS summary, ['n1', 'n2'] AS ids, 'cat_old' AS key FROM th WHERE theme_id % 3 = 0),
agg AS (SELECT theme_id, count(DISTINCT nullif(lower(trim(publisher)), '')) AS publishers, count(DISTINCT title) AS titles, arg_min(summary, news_id) AS first, list(news_id::VARCHAR ORDER BY news_id) AS ids, list_sort(list_distinct(flatten(list(entities)))) AS ent FROM evi GROUP BY 1),
j AS (SELECT ctx.*, publishers, titles, first, agg.ids, CASE WHEN len(ent) > 0 THEN 'cat_' || substr(sha256(ctx.theme_id || '|' || array_to_string(ent, ',')), 1, 24) END AS key, old.status AS os, old.summary AS osum, old.ids AS oids, old.key AS okey FROM ctx LEFT JOIN agg USING (theme_id) LEFT JOIN old USING (theme_id)),
k AS (SELECT *, CASE WHEN after_close IS NOT NULL THEN 'CLOSE' WHEN publishers >= 2 AND titles >= 2 THEN 'PUBLISHERS' WHEN publishers IS NOT NULL AND list_contains(known, key) THEN 'KNOWN' WHEN publishers IS NOT NULL THEN 'ONE' WHEN os IN ('SINGLE_SOURCE', 'REEMERGENCE', 'MULTI_SOURCE_CONFIRMED', 'AFTER_CLOSE_CONFIRMED') THEN 'KEPT' WHEN degraded THEN 'DEGRADED' WHEN now - activated_at >= INTERVAL 10 MINUTE THEN 'NOTHING' ELSE 'EARLY' END AS reason FROM j)"""


@query(
    f"WITH {_EVIDENCE} SELECT theme_id, reason, CASE reason WHEN 'CLOSE' THEN 'AFTER_CLOSE_CONFIRMED' WHEN 'PUBLISHERS' THEN 'MULTI_SOURCE_CONFIRMED' WHEN 'KNOWN' THEN 'REEMERGENCE' WHEN 'ONE' THEN 'SINGLE_SOURCE' WHEN 'KEPT' THEN os WHEN 'NOTHING' THEN 'NO_NEW_CATALYST' ELSE 'SEARCHING' END AS status, "
    "CASE WHEN reason = 'CLOSE' THEN after_close WHEN reason = 'KEPT' THEN osum WHEN reason IN ('PUBLISHERS', 'KNOWN', 'ONE') THEN first END AS summary, array_to_string(CASE WHEN reason = 'KEPT' THEN oids WHEN reason IN ('CLOSE', 'PUBLISHERS', 'KNOWN', 'ONE') THEN coalesce(ids, []) ELSE [] END, ',') AS news_ids, CASE WHEN reason = 'KEPT' THEN okey WHEN reason IN ('CLOSE', 'PUBLISHERS', 'KNOWN', 'ONE') THEN key END AS catalyst_key FROM k"
)
def evidence_decision(spark, d):
    """What the evidence of each theme allows to say, with the earlier decision and the state of the sources."""
    e = table(spark, d, "events")
    u, i = F.col("user_id"), F.col("event_id")
    th = e.groupBy(u.alias("theme_id")).agg(F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("first_signup"), F.max("ts").alias("now"))
    t = F.col("theme_id")
    known = F.when(t % 2 == 0, F.array(F.concat(F.lit("cat_"), F.substring(F.sha2(F.concat(t.cast("string"), F.lit("|e1")), 256), 1, 24)))).otherwise(F.array().cast("array<string>"))
    contexts = th.select("theme_id", F.coalesce("first_signup", F.col("now") - F.expr("INTERVAL 5 MINUTE")).alias("activated_at"), "now", known.alias("known_keys"), (t % 7 == 0).alias("degraded"), F.when(t % 11 == 0, F.concat(F.lit("closed "), t.cast("string"))).alias("after_close"))
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    n = e.where(F.col("event_type").isin("view", "click") & (F.col("ts") >= day("2024-01-10")) & (F.col("ts") < day("2024-01-20")) & ((u % 4 > 0) | (i % 5 == 0)))
    entities = F.when(i % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("e"), (i % 2).cast("string"))))
    news = n.select(u.alias("theme_id"), i.alias("place"), i.alias("news_id"), F.get(F.array(*map(F.lit, ("Alpha", " alpha", "Beta", " "))), (i % 4).cast("int")).alias("publisher"), F.concat(F.lit("Title  "), (i % 3).cast("string")).alias("title"), F.concat(F.lit("s"), i.cast("string")).alias("summary"), entities.alias("entities"))
    states = F.get(F.array(*map(F.lit, ("SEARCHING", "SINGLE_SOURCE", "MULTI_SOURCE_CONFIRMED", "NO_NEW_CATALYST"))), (F.floor(t / 3) % 4).cast("int"))
    previous = th.where(t % 3 == 0).select("theme_id", states.alias("status"), F.concat(F.lit("old"), t.cast("string")).alias("summary"), F.array(F.lit("n1"), F.lit("n2")).alias("news_ids"), F.lit("cat_old").alias("catalyst_key"))
    return L.evidence_decisions(contexts, news, previous).withColumn("news_ids", F.array_join("news_ids", ","))
