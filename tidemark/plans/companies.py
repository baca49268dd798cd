"""Companies, projects, graphs and audits: part names as company names over time, orders as records, events as captures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import events as E
from ..operators import audits, timeseries
from ..sources.tables import daily_prices, table
from . import textual
from .market import _ATT, _attention
from .queries import _DAILY, query, r6

# name observations: a stock is called by its part's brand, by its orders' status and by its lines' flag, at different times
_OBSERVED = "obs AS (SELECT l_partkey AS code, l_returnflag || '-' || l_linestatus AS name, l_shipdate::DATE AS day, CASE l_linenumber % 3 WHEN 0 THEN 30 WHEN 1 THEN 20 ELSE 10 END AS authority FROM lineitem)"


def _observed(spark, d):
    rank = F.when(F.col("l_linenumber") % 3 == 0, 30).when(F.col("l_linenumber") % 3 == 1, 20).otherwise(10)
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("code"), F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("name"), F.to_date("l_shipdate").alias("day"), rank.alias("authority"))


@query(
    f"WITH {_OBSERVED}, w AS (SELECT code, name, min(day) AS first_day, max(day) AS last_day, count(*) AS n, max(authority) AS authority FROM obs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY authority DESC, last_day DESC, n DESC, name) AS place, lead(first_day) OVER (PARTITION BY code ORDER BY first_day, name) AS next_first FROM w) "
    "SELECT code, name, first_day AS valid_from, CASE WHEN place = 1 THEN NULL ELSE last_day END AS valid_to, place = 1 AS current, coalesce(next_first > last_day, FALSE) AS renamed FROM r"
)
def company_master(spark, d):
    """Names with their validity: the current one (by authority, newest, most often seen) is open; a rename only where the name had ended before the next began."""
    w = _observed(spark, d).groupBy("code", "name").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"), F.max("authority").alias("authority"))
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.col("authority").desc(), F.col("last_day").desc(), F.col("n").desc(), "name"))
    following = F.lead("first_day").over(Window.partitionBy("code").orderBy("first_day", "name"))
    r = w.withColumn("place", place).withColumn("next_first", following)
    return r.select("code", "name", F.col("first_day").alias("valid_from"), F.when(F.col("place") != 1, F.col("last_day")).alias("valid_to"), (F.col("place") == 1).alias("current"), F.coalesce(F.col("next_first") > F.col("last_day"), F.lit(False)).alias("renamed"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE sha256(o_custkey || '|' || lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', '', 'g'))) END AS fingerprint FROM orders")
def project_fingerprint(spark, d):
    """Explicit projects alone have one: the hash of the owner and the normalized name."""
    name = F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]+", ""))
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), name), 256)).alias("fingerprint"))


@query(
    "WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_discount < 0.02 THEN 'SECTION' WHEN l_discount < 0.05 THEN 'THEME' ELSE 'STOCK' END AS kind FROM lineitem) "
    "SELECT l_orderkey, kind, CASE kind WHEN 'SECTION' THEN 'POST' WHEN 'THEME' THEN 'SECTION' ELSE 'THEME' END AS scope, count(*) AS n, CASE WHEN count(DISTINCT l_suppkey) = count(*) THEN 'DISTINCT' ELSE 'REPEATED' END AS status, sha256(string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_linenumber, l_suppkey)) AS hash FROM r GROUP BY 1, 2, 3"
)
def daily_mentions(spark, d):
    kind = F.when(F.col("l_discount") < 0.02, "SECTION").when(F.col("l_discount") < 0.05, "THEME").otherwise("STOCK")
    g = table(spark, d, "lineitem").groupBy("l_orderkey", kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("different"), F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("x"))
    scope = F.when(F.col("kind") == "SECTION", "POST").when(F.col("kind") == "THEME", "SECTION").otherwise("THEME")
    return g.select("l_orderkey", "kind", scope.alias("scope"), "n", F.when(F.col("different") == F.col("n"), "DISTINCT").otherwise("REPEATED").alias("status"), F.sha2(F.array_join(F.transform("x", lambda y: y["l_suppkey"].cast("string")), ","), 256).alias("hash"))


@query(
    "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax < 0.03 THEN l_returnflag END AS theme FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, last_value(theme IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, theme ROWS UNBOUNDED PRECEDING) AS theme FROM r"
)
def carried_themes(spark, d):
    """Rows of a post's table; an empty theme cell takes the one above."""
    l = table(spark, d, "lineitem").withColumn("theme", F.when(F.col("l_tax") < 0.03, F.col("l_returnflag")))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", F.col("theme").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.last("theme", ignorenulls=True).over(w).alias("theme"))


_NAMES = "(the article|the|article|ist das|das|in the|und)"


@query(f"SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_NAMES}', 1)) AS name FROM documents) GROUP BY 1, 2")
def dictionary_tags(spark, d):
    """Names that stand outside every longer name's span: longer names are tried first, spans don't overlap."""
    return table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_NAMES), 1)).alias("name")).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query(
    "WITH s AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') AS source, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY 1), w AS (SELECT conv_id, source, string_split(answer, ' ') AS a FROM s WHERE source IS NOT NULL AND answer IS NOT NULL) "
    "SELECT conv_id, len(a) AS words, coalesce(list_bool_or(list_transform(range(1, len(a) - 2), lambda i: contains(source, array_to_string(a[i:i + 3], ' ')))), FALSE) AS verbatim, coalesce(len(list_filter(list_distinct(a), lambda x: contains(source, x))), 0) AS grounded FROM w"
)
def grounding(spark, d):
    """Answers against their source: whether a run of four words is taken over as it is, and how many different words the source holds."""
    said = lambda role: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda y: y["text"]), " ")
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("v"), said("user").alias("source"), said("assistant").alias("answer"))
    w = s.where("u > 0 and v > 0").withColumn("a", F.split("answer", " "))
    runs = F.when(F.size("a") >= 4, F.sequence(F.lit(1), F.size("a") - 3)).otherwise(F.array().cast("array<int>"))
    verbatim = F.exists(runs, lambda i: F.contains(F.col("source"), F.array_join(F.slice("a", i, F.lit(4)), " ")))
    grounded = F.size(F.filter(F.array_distinct("a"), lambda x: F.contains(F.col("source"), x)))
    return w.select("conv_id", F.size("a").cast("long").alias("words"), verbatim.alias("verbatim"), grounded.cast("long").alias("grounded"))


@query(
    "WITH c AS (SELECT doc_id, unnest(string_split(split_part(lower(text), ' because ', 1), ' and ')) AS clause FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS clauses, count(*) FILTER (contains(clause, 'the ') AND regexp_matches(clause, 'of the|der')) AS matching FROM c GROUP BY 1"
)
def topic_clauses(spark, d):
    """Clauses before the cause that hold both the topic and a marker of the type."""
    c = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split(F.split(F.lower("text"), " because ", 2)[0], " and ")).alias("clause"))
    return c.groupBy("doc_id").agg(F.count("*").alias("clauses"), F.count_if(F.contains("clause", F.lit("the ")) & F.rlike("clause", F.lit("|".join(E.TYPES[0][1])))).alias("matching"))


_ISL = "q AS (SELECT *, sum(CASE WHEN a IS DISTINCT FROM FALSE THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY day_number ROWS UNBOUNDED PRECEDING) AS reset FROM k), b AS (SELECT *, sum(CASE WHEN NOT a THEN 1 ELSE 0 END) OVER (PARTITION BY key, reset ORDER BY day_number ROWS UNBOUNDED PRECEDING) AS absent FROM q), e AS (SELECT *, sum(CASE WHEN absent = 4 AND NOT a THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY day_number ROWS UNBOUNDED PRECEDING) AS ended FROM b), t AS (SELECT *, CASE WHEN lag(ended) OVER w IS NULL OR ended > lag(ended) OVER w THEN 1 ELSE 0 END AS starts FROM e WHERE a WINDOW w AS (PARTITION BY key ORDER BY day_number)), i AS (SELECT key, island, min(day_number) AS first_day, max(day_number) AS last_day FROM (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY day_number ROWS UNBOUNDED PRECEDING) AS island FROM t) GROUP BY 1, 2)"


@query(
    f"WITH {_ATT}, k AS (SELECT theme_id * 4 + bucket AS key, day_number, CASE WHEN reason IS NULL THEN multiple >= 1.2 END AS a FROM att), {_ISL}, g AS (SELECT *, lag(last_day) OVER (PARTITION BY key ORDER BY island) AS before FROM i) SELECT g.key, g.island, CASE WHEN before IS NULL THEN 'FIRST' WHEN count(k.day_number) FILTER (a IS NULL) > 0 THEN 'UNKNOWN_DAYS' ELSE 'CONFIRMED' END AS status, CASE WHEN before IS NOT NULL AND count(k.day_number) FILTER (a IS NULL) = 0 THEN count(k.day_number) END AS gap FROM g LEFT JOIN k ON k.key = g.key AND k.day_number > before AND k.day_number < g.first_day GROUP BY 1, 2, before"
)
def attention_gaps(spark, d):
    """Between two runs of attention: how many days, if each of them is confirmed to be without."""
    s = _attention(spark, d).select((F.col("theme_id") * 4 + F.col("bucket")).alias("key"), "day_number", F.when(F.col("reason").isNull(), F.col("multiple") >= 1.2).alias("is_attention"))
    w = Window.partitionBy("key").orderBy("island")
    g = timeseries.attention_islands(s, 4).withColumn("before", F.lag("last_day").over(w))
    # counts up to each day: the days between are a difference of two, no range join
    upto = Window.partitionBy("key").orderBy("day_number")
    c = s.select("key", "day_number", F.count("*").over(upto).alias("days"), F.count_if(F.col("is_attention").isNull()).over(upto).alias("unknown"))
    x = g.join(c.select("key", F.col("day_number").alias("first_day"), F.col("days").alias("d1"), F.col("unknown").alias("u1")), ["key", "first_day"]).join(c.select("key", F.col("day_number").alias("before"), F.col("days").alias("d0"), F.col("unknown").alias("u0")), ["key", "before"], "left")
    status = F.when(F.col("before").isNull(), "FIRST").when(F.col("u1") > F.col("u0"), "UNKNOWN_DAYS").otherwise("CONFIRMED")
    return x.select("key", "island", status.alias("status"), F.when(status == "CONFIRMED", F.col("d1") - F.col("d0") - 1).alias("gap"))


@query(
    "WITH t AS (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS before_item FROM events), m AS (SELECT event_type, count(DISTINCT date_trunc('hour', ts)) AS hours, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1), a AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events) "
    "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS items, max(epoch_us(ts) - epoch_us(before)) // 1000000 AS max_gap_s, max(epoch_us(ts) - epoch_us(before_item)) // 1000000 AS max_item_gap_s, any_value(hours) AS hours, (SELECT count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = t.event_type AND date_trunc('hour', x.ts) = a.h)) AS missing_hours FROM t JOIN m USING (event_type) GROUP BY event_type"
)
def capture_audit(spark, d):
    """Per source: counts, greatest gaps of the source and of an item, hours with and without records."""
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("kind", F.col("event_type"))
    t = audits.since_last(e, "us", ("us", "event_id"), F.floor(F.col("us") / 3_600_000_000)).withColumn("gap", F.col("us") - F.col("before"))
    item = Window.partitionBy("event_type", "user_id").orderBy("us", "event_id")
    t = t.withColumn("item_gap", F.col("us") - F.lag("us").over(item)).withColumn("hour", F.date_trunc("hour", "ts"))
    every = e.select(F.date_trunc("hour", "ts").alias("hour")).distinct().agg(F.count("*").alias("every"))
    g = t.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("items"), F.floor(F.max("gap") / 1_000_000).alias("max_gap_s"), F.floor(F.max("item_gap") / 1_000_000).alias("max_item_gap_s"), F.countDistinct("hour").alias("hours"))
    return g.crossJoin(F.broadcast(every)).withColumn("missing_hours", F.col("every") - F.col("hours")).drop("every")


@query(
    f"WITH {_DAILY}, m AS (SELECT stock_id, day, (close / lag(close) OVER (PARTITION BY stock_id ORDER BY day) - 1) * 100 AS ret FROM daily), lead_set AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 40) SELECT DISTINCT l.l_orderkey AS event, l.l_partkey AS member, CASE WHEN s.l_partkey IS NOT NULL THEN 'LEADER' ELSE 'RELATED' END AS role, round(m.ret, 6) AS ret FROM lineitem l LEFT JOIN lead_set s ON s.l_orderkey = l.l_orderkey AND s.l_partkey = l.l_partkey LEFT JOIN m ON m.stock_id = l.l_partkey AND m.day = l.l_shipdate::DATE"
)
def historical_event_detail(spark, d):
    """Members of an event with their role and, where priced, their return of the day."""
    w = Window.partitionBy("stock_id").orderBy("day")
    m = daily_prices(spark, d).select(F.col("stock_id").alias("member"), "day", ((F.try_divide(F.col("close"), F.lag("close").over(w)) - 1) * 100).alias("ret"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("member"), F.to_date("l_shipdate").alias("day"), (F.col("l_quantity") >= 40).alias("leads"))
    roles = l.groupBy("event", "member").agg(F.max("leads").alias("leads"))
    days = l.select("event", "member", "day").distinct()
    return days.join(roles, ["event", "member"]).join(m, ["member", "day"], "left").select("event", "member", F.when(F.col("leads"), "LEADER").otherwise("RELATED").alias("role"), r6("ret").alias("ret")).distinct()


@query(
    "WITH e AS (SELECT DISTINCT p_brand AS theme, l_orderkey AS event, o_orderpriority AS type FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey) SELECT 'theme' AS kind, theme AS name, count(*) AS degree FROM e GROUP BY theme UNION ALL SELECT 'type', type, count(DISTINCT event) FROM e GROUP BY type"
)
def theme_graph(spark, d):
    """The graph of themes, events and types: each theme's and type's degree."""
    l = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("theme")), "l_partkey").select("theme", F.col("l_orderkey").alias("event")).distinct()
    e = l.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_orderpriority").alias("type")), "event")
    a = e.groupBy(F.col("theme").alias("name")).agg(F.count("*").alias("degree")).select(F.lit("theme").alias("kind"), "name", "degree")
    b = e.groupBy(F.col("type").alias("name")).agg(F.countDistinct("event").alias("degree")).select(F.lit("type").alias("kind"), "name", "degree")
    return a.unionByName(b)


@query(
    "WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, arg_max(l_discount, (l_returnflag, l_linenumber, l_discount)) AS outcome FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'N' GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (outcome IS NULL), o_orderdate DESC, o_orderkey) AS place FROM o) SELECT o_custkey, count(*) AS cases, count(outcome) AS observed, count(*) FILTER (outcome > 0.05) AS positive, round(median(outcome), 6) AS median_outcome, max(CASE WHEN place = 1 THEN o_orderkey END) AS first_case FROM r GROUP BY 1"
)
def similar_case_report(spark, d):
    """Cases with the preferred version of their outcome: observed ones first, then the newest."""
    l = table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max_by("l_discount", F.struct("l_returnflag", "l_linenumber", "l_discount")).alias("outcome"))
    o = table(spark, d, "orders").join(l, "o_orderkey", "left")
    w = Window.partitionBy("o_custkey").orderBy(F.col("outcome").isNull(), F.col("o_orderdate").desc(), "o_orderkey")
    r = o.withColumn("place", F.row_number().over(w))
    return r.groupBy("o_custkey").agg(F.count("*").alias("cases"), F.count("outcome").alias("observed"), F.count_if(F.col("outcome") > 0.05).alias("positive"), r6(F.median("outcome")).alias("median_outcome"), F.max(F.when(F.col("place") == 1, F.col("o_orderkey"))).alias("first_case"))


@query("SELECT 'orders' AS part, count(*) > 0 AS present FROM orders UNION ALL SELECT 'priced', count(*) > 0 FROM lineitem WHERE l_extendedprice > 0 UNION ALL SELECT 'labels', count(*) > 0 FROM labels WHERE toxic = 1 AND quality = 1")
def prerequisites(spark, d):
    has = lambda name, df: df.limit(1).agg((F.count("*") > 0).alias("present")).select(F.lit(name).alias("part"), "present")
    return has("orders", table(spark, d, "orders")).unionByName(has("priced", table(spark, d, "lineitem").where("l_extendedprice > 0"))).unionByName(has("labels", table(spark, d, "labels").where("toxic = 1 and quality = 1")))


@query(
    "WITH c AS (SELECT user_id AS id, event_id AS arrival, event_type AS kind, round(value)::BIGINT AS version, ts FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival) AS n, max(version) OVER b AS top, max(ts) OVER b AS last, lag(kind) OVER (PARTITION BY id ORDER BY arrival) AS previous FROM c WINDOW b AS (PARTITION BY id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT id, arrival, CASE WHEN n = 1 THEN 'CREATED' WHEN kind = 'signup' THEN 'DUPLICATE_IDENTITY' WHEN version < top THEN 'STALE_VERSION' WHEN ts < last THEN 'STALE_TIME' WHEN kind = previous THEN 'ALREADY' ELSE 'TRANSITIONED' END AS receipt FROM k"
)
def event_writer(spark, d):
    """The receipt of each command on an event, in order of arrival: created once; older versions and times are refused, repeats change nothing."""
    c = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("arrival"), F.col("event_type").alias("kind"), F.round("value").cast("long").alias("version"), "ts")
    w = Window.partitionBy("id").orderBy("arrival")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    k = c.withColumns({"n": F.row_number().over(w), "top": F.max("version").over(before), "last": F.max("ts").over(before), "previous": F.lag("kind").over(w)})
    receipt = F.when(F.col("n") == 1, "CREATED").when(F.col("kind") == "signup", "DUPLICATE_IDENTITY").when(F.col("version") < F.col("top"), "STALE_VERSION").when(F.col("ts") < F.col("last"), "STALE_TIME").when(F.col("kind") == F.col("previous"), "ALREADY").otherwise("TRANSITIONED")
    return k.select("id", "arrival", receipt.alias("receipt"))


# markers of money facts, first of higher rank
_FACTS = (("SALES", ("the ",)), ("INVESTMENT", ("of ",)), ("STAKE", ("in ",)), ("ORDER", ("and ",)))
_NEAR = ", ".join(
    f"CASE WHEN strpos(reverse(b), '{m[::-1]}') > 0 THEN (strpos(reverse(b), '{m[::-1]}') - 1, {i}, '{name}') END, CASE WHEN strpos(a, '{m}') > 0 THEN (strpos(a, '{m}') - 1, {i}, '{name}') END" for i, (name, ms) in enumerate(_FACTS) for m in ms
)
_CAUSES_SQL = textual._CAUSES


@query(
    rf"WITH {_CAUSES_SQL}, v AS (SELECT doc_id, place, lower(s) AS s, regexp_extract(s, '[0-9]{{2,9}}', 0) AS m FROM causes WHERE regexp_matches(s, '[0-9]{{2,9}}')), w AS (SELECT *, substr(s, greatest(strpos(s, m) - 18, 1), strpos(s, m) - greatest(strpos(s, m) - 18, 1)) AS b, substr(s, strpos(s, m) + length(m), 18) AS a FROM v) "
    f"SELECT doc_id, place, m AS value, coalesce(list_min(list_filter([{_NEAR}], lambda x: x IS NOT NULL))[3], 'OTHER') AS fact FROM w"
)
def money_fact_types(spark, d):
    """The first number of a sentence and the fact that the nearest marker within 18 characters makes it; the nearer, then the first in rank."""
    v = textual.causes(spark, d).withColumn("m", F.regexp_extract("s", "[0-9]{2,9}", 0)).where("m <> ''").withColumn("s", F.lower("s")).withColumn("at", F.position("m", "s"))
    v = v.withColumn("from", F.greatest(F.col("at") - 18, F.lit(1))).withColumn("b", F.substring("s", F.col("from"), F.col("at") - F.col("from"))).withColumn("a", F.substring("s", F.col("at") + F.length("m"), F.lit(18)))
    near = []
    for i, (name, ms) in enumerate(_FACTS):
        for m in ms:
            for where in (F.locate(m[::-1], F.reverse("b")), F.locate(m, F.col("a"))):
                near.append(F.when(where > 0, F.struct((where - 1).alias("away"), F.lit(i).alias("rank"), F.lit(name).alias("name"))))
    best = F.array_min(F.array_compact(F.array(*near)))
    return v.select("doc_id", "place", F.col("m").alias("value"), F.coalesce(best["name"], F.lit("OTHER")).alias("fact"))


@query(f"WITH {_CAUSES_SQL} SELECT doc_id, place, {textual._sql_primary('s')} AS primary_type, {textual._sql_rightmost('s', E.CERTAINTY, 'UNSPECIFIED')} AS certainty, {textual._STAGE} AS stage, sha256(doc_id || '|' || {textual._sql_primary('s')} || '|' || {textual._STAGE} || '|' || lower(s)) AS identity FROM causes")
def structure_history(spark, d):
    """Every sentence as an event: type, certainty, stage and the identity that equal events share within a document."""
    s = F.col("s")
    x = textual.causes(spark, d).select("doc_id", "place", "s", E.primary_type(s).alias("primary_type"), E.certainty(s).alias("certainty"), E.stage(s).alias("stage"))
    identity = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "primary_type", "stage", F.lower("s")), 256)
    return x.select("doc_id", "place", "primary_type", "certainty", "stage", identity.alias("identity"))


@query("WITH l AS (SELECT max(o_orderdate) AS newest FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-30'), f AS (SELECT o_orderkey, l_returnflag AS section, p_brand AS theme FROM orders, l, lineitem, part WHERE o_orderdate = newest AND l_orderkey = o_orderkey AND p_partkey = l_partkey) SELECT o_orderkey, section, string_agg(DISTINCT theme, ',' ORDER BY theme) AS themes FROM f GROUP BY 1, 2")
def daily_featured(spark, d):
    """Posts of the latest day by the day asked for, with the themes of their sections."""
    o = table(spark, d, "orders").where(F.col("o_orderdate") <= F.lit("1999-06-30").cast("timestamp_ntz"))
    newest = o.agg(F.max("o_orderdate").alias("o_orderdate"))
    l = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(o.join(F.broadcast(newest), "o_orderdate").select("o_orderkey"), "o_orderkey")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return l.join(p, "l_partkey").groupBy("o_orderkey", F.col("l_returnflag").alias("section")).agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("themes"))


@query("""WITH r AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS names FROM pages) SELECT page_id, n - 1 AS place, hrefs[n] AS href, names[n] AS name FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS n FROM r)""")
def page_rows(spark, d):
    """The rows of a page's lists, in order: where they lead and what they are called."""
    pattern = F.lit('<li><a href="([^"]*)">([^<]*)</a></li>')
    r = table(spark, d, "pages").select("page_id", F.arrays_zip(F.regexp_extract_all("html", pattern, 1).alias("href"), F.regexp_extract_all("html", pattern, 2).alias("name")).alias("r"))
    return r.select("page_id", F.posexplode("r").alias("place", "x")).select("page_id", F.col("place").cast("long").alias("place"), "x.href", "x.name")
