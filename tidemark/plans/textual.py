"""Queries that turn texts into structured events. Documents are posts, their first line the title, their sentences causes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import events as E
from ..functions import text as T
from ..sources.tables import table
from .queries import query

_MARK = E.alternation(E.TYPES)


def _sql_types(t: str) -> str:
    claimed = f"list_distinct(regexp_extract_all(lower({t}), '{_MARK}', 1))"
    named = ", ".join(f"CASE WHEN list_has_any({claimed}, {list(ms)!r}) THEN '{name}' END" for name, ms in E.TYPES)
    return f"list_filter([{named}], lambda x: x IS NOT NULL)"


def _sql_primary(t: str) -> str:
    return f"CASE regexp_extract(lower({t}), '{_MARK}', 1) " + " ".join(f"WHEN '{m}' THEN '{name}'" for name, ms in E.TYPES for m in ms) + " ELSE 'OTHER' END"


def _sql_rightmost(t: str, vocabulary: tuple, otherwise: str) -> str:
    found = ", ".join(f"CASE WHEN strpos(reverse(lower({t})), '{m[::-1]}') > 0 THEN (length({t}) - strpos(reverse(lower({t})), '{m[::-1]}') + 1, {len(m)}, {-i}, '{name}') END" for i, (name, ms) in enumerate(vocabulary) for m in ms)
    return f"coalesce(list_max(list_filter([{found}], lambda x: x IS NOT NULL))[4], '{otherwise}')"


_MIXED = " OR ".join(f"contains(lower(s), '{m}')" for m in E.MIXED)
_CONT = ", ".join(f"CASE WHEN strpos(lower(s), '{m}') > 0 THEN (strpos(lower(s), '{m}'), '{m}') END" for m in E.CONTINUATION)
# causes: the sentences of a text; the title is the first line
_CAUSES = r"causes AS (SELECT doc_id, lang, n - 1 AS place, trim(s) AS s FROM (SELECT doc_id, lang, unnest(p) AS s, unnest(range(1, len(p) + 1)) AS n FROM (SELECT doc_id, lang, regexp_split_to_array(text, '[.;!?\n]+') AS p FROM documents)) WHERE length(trim(s)) > 0)"
_LABELS = f"{_CAUSES}, labelled AS (SELECT doc_id, lang, place, {_sql_types('s')} AS t, {_sql_primary('s')} AS primary_type, CASE WHEN {_MIXED} THEN 'MIXED' ELSE {_sql_rightmost('s', (('UP', E.UP), ('DOWN', E.DOWN)), 'UNKNOWN')} END AS direction, {_sql_rightmost('s', E.CERTAINTY, 'UNSPECIFIED')} AS certainty, list_min(list_filter([{_CONT}], lambda x: x IS NOT NULL))[2] AS continuation, s FROM causes)"


def causes(spark, d):
    # a file's row group is one task: texts are spread before they are taken apart
    docs = table(spark, d, "documents").select("doc_id", "lang", "text").repartition("doc_id")
    s = docs.select("doc_id", "lang", F.posexplode(F.split("text", r"[.;!?\n]+")).alias("place", "s")).withColumn("s", F.trim("s"))
    return s.where("length(s) > 0").withColumn("place", F.col("place").cast("long"))


def labels(spark, d):
    s = F.col("s")
    return causes(spark, d).withColumns({"t": E.types(s), "primary_type": E.primary_type(s), "direction": E.direction(s), "certainty": E.certainty(s), "continuation": E.continuation(s)})


@query(f"WITH {_LABELS} SELECT doc_id, place, CASE WHEN len(t) = 0 THEN 'OTHER' ELSE array_to_string(t, ',') END AS types, primary_type, direction, certainty, continuation FROM labelled")
def classify_catalyst(spark, d):
    return labels(spark, d).select("doc_id", "place", F.array_join("t", ",").alias("types"), "primary_type", "direction", "certainty", "continuation")


@query(f"WITH {_LABELS}, x AS (SELECT lang, primary_type, direction, certainty, count(*) AS n, count(continuation) AS continued FROM labelled GROUP BY 1, 2, 3, 4) SELECT *, round(sum(CASE WHEN primary_type = 'OTHER' THEN n ELSE 0 END) OVER (PARTITION BY lang) / sum(n) OVER (PARTITION BY lang), 6) AS unclassified, CASE WHEN sum(CASE WHEN primary_type = 'OTHER' THEN n ELSE 0 END) OVER (PARTITION BY lang) / sum(n) OVER (PARTITION BY lang) <= 0.1 THEN 'GO' WHEN sum(CASE WHEN primary_type = 'OTHER' THEN n ELSE 0 END) OVER (PARTITION BY lang) / sum(n) OVER (PARTITION BY lang) <= 0.3 THEN 'REVIEW' ELSE 'REDESIGN' END AS gate FROM x")
def label_history(spark, d):
    x = labels(spark, d).groupBy("lang", "primary_type", "direction", "certainty").agg(F.count("*").alias("n"), F.count("continuation").alias("continued"))
    w = Window.partitionBy("lang")
    share = F.sum(F.when(F.col("primary_type") == "OTHER", F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w)
    return x.withColumn("unclassified", F.round(share, 6)).withColumn("gate", F.when(share <= 0.1, "GO").when(share <= 0.3, "REVIEW").otherwise("REDESIGN"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ ]*\([^()]*\)[ ]*$', '')) AS cause FROM documents WHERE text IS NOT NULL")
def cause_sentence(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", E.cause_sentence(F.col("text")).alias("cause"))


_ACT = "regexp_matches(lower({}), 'is |was |es |ist ')"


@query(f"WITH {_CAUSES}, p AS (SELECT doc_id, place, unnest(string_split(s, ', ')) AS x, unnest(range(len(string_split(s, ', ')))) AS i FROM causes), f AS (SELECT *, {_ACT.format('x')} AS has, coalesce(lag({_ACT.format('x')}) OVER w, FALSE) AS had FROM p WINDOW w AS (PARTITION BY doc_id, place ORDER BY i)), g AS (SELECT *, sum(CASE WHEN has AND had THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, place ORDER BY i ROWS UNBOUNDED PRECEDING) AS clause FROM f) SELECT doc_id, place, clause::BIGINT AS clause, string_agg(x, ', ' ORDER BY i) AS text FROM g GROUP BY 1, 2, 3")
def split_event_clauses(spark, d):
    """Hard breaks between sentences; a comma breaks only between two parts that both hold an action."""
    p = causes(spark, d).select("doc_id", "place", F.posexplode(F.split("s", ", ")).alias("i", "x")).withColumn("has", F.rlike(F.lower("x"), F.lit("is |was |es |ist ")))
    w = Window.partitionBy("doc_id", "place").orderBy("i")
    p = p.withColumn("breaks", (F.col("has") & F.coalesce(F.lag("has").over(w), F.lit(False))).cast("long")).withColumn("clause", F.sum("breaks").over(w))
    return p.groupBy("doc_id", "place", "clause").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]), ", ").alias("text"))


_AT = ", ".join(f"CASE WHEN strpos(lower(s), '{m}') > 0 THEN (strpos(lower(s), '{m}'), {-len(m)}, '{m}') END" for m in E.ACTIONS)


@query(f"WITH {_CAUSES}, a AS (SELECT *, list_min(list_filter([{_AT}], lambda x: x IS NOT NULL)) AS f FROM causes) SELECT doc_id, place, trim(f[3]) AS action, trim(substr(s, 1, f[1] - 1)) AS object FROM a WHERE f IS NOT NULL")
def action_and_object(spark, d):
    a = causes(spark, d).select("doc_id", "place", E.action(F.col("s")).alias("a"))
    return a.where("a.marker is not null").select("doc_id", "place", F.col("a.marker").alias("action"), F.col("a.object").alias("object"))


_STAGE = f"CASE WHEN {_sql_rightmost('s', E.STAGES[1:], '')} <> '' THEN {_sql_rightmost('s', E.STAGES[1:], '')} ELSE {_sql_rightmost('s', E.STAGES[:1], 'UNSPECIFIED')} END"


@query(f"WITH {_CAUSES} SELECT doc_id, place, {_STAGE} AS stage FROM causes")
def event_stage(spark, d):
    return causes(spark, d).select("doc_id", "place", E.stage(F.col("s")).alias("stage"))


_VALUE = r"([0-9]{1,9})(%| km| kg|\.[0-9]{1,2})?"


@query(
    rf"WITH {_CAUSES}, v AS (SELECT doc_id, place, s, unnest(regexp_extract_all(s, '{_VALUE}', 0)) AS m FROM causes), u AS (SELECT *, lower(substr(s, greatest(strpos(s, m) - 18, 1), 36 + length(m))) AS w FROM v), "
    "b AS (SELECT doc_id, place, m, CASE WHEN m LIKE '%\\%' ESCAPE '\\' THEN 'PERCENT' WHEN m LIKE '% km' OR m LIKE '% kg' THEN 'QUANTITY' WHEN contains(m, '.') THEN 'MONEY' ELSE 'NUMBER' END AS kind, regexp_extract(m, '^[0-9.]*[0-9]', 0)::DOUBLE AS value, CASE WHEN regexp_matches(w, 'of the|total') THEN 'TOTAL_PROJECT' WHEN regexp_matches(w, 'share') THEN 'COMPANY_SHARE' WHEN regexp_matches(w, 'up to| to ') THEN 'UP_TO' WHEN regexp_matches(w, 'at least| in ') THEN 'LOWER_BOUND' WHEN regexp_matches(w, 'about| and ') THEN 'ESTIMATE' WHEN regexp_matches(w, 'between') THEN 'RANGE' ELSE 'EXACT' END AS basis FROM u) "
    "SELECT doc_id, place, kind, basis, value, basis IN ('EXACT', 'COMPANY_SHARE') AS summable, count(*) AS n FROM b GROUP BY 1, 2, 3, 4, 5, 6"
)
def value_facts(spark, d):
    """Values with their kind, what they stand for (words within 18 characters) and whether they may be added up."""
    v = causes(spark, d).select("doc_id", "place", "s", F.explode(F.regexp_extract_all("s", F.lit(_VALUE), 0)).alias("m"))
    v = v.withColumn("w", F.substring("s", F.greatest(F.position("m", "s") - 18, F.lit(1)), 36 + F.length("m")))
    kind = F.when(F.endswith("m", F.lit("%")), "PERCENT").when(F.endswith("m", F.lit(" km")) | F.endswith("m", F.lit(" kg")), "QUANTITY").when(F.contains("m", F.lit(".")), "MONEY").otherwise("NUMBER")
    b = v.select("doc_id", "place", kind.alias("kind"), E.basis(F.col("w")).alias("basis"), F.regexp_extract("m", "^[0-9.]*[0-9]", 0).cast("double").alias("value"))
    return b.withColumn("summable", F.col("basis").isin("EXACT", "COMPANY_SHARE")).groupBy("doc_id", "place", "kind", "basis", "value", "summable").agg(F.count("*").alias("n"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' Co. (' || p_brand || ')'), '\b(inc|corp|co|ltd|plc|ag|sa)\b\.?|\(.*?\)', '', 'g'), '[\s#]+', '', 'g') AS name FROM part")
def normalized_names(spark, d):
    return table(spark, d, "part").select("p_partkey", E.normalized_name(F.concat("p_name", F.lit(" Co. ("), "p_brand", F.lit(")"))).alias("name"))


_TITLE = r"trim(regexp_replace(lower(regexp_replace(split_part(text, chr(10), 1), '\[[^\]]*\]|\([^)]*\)', ' ', 'g')), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_TITLE} AS title, sha256({_TITLE}) AS title_hash FROM documents WHERE text IS NOT NULL")
def title_hashes(spark, d):
    t = E.normalized_title(F.split("text", "\n", 2)[0])
    return table(spark, d, "documents").where("text is not null").select("doc_id", t.alias("title"), F.sha2(t, 256).alias("title_hash"))


@query(r"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || '/' || p_type), '[/,()\s.]+'), lambda p: length(p) >= 2 AND p NOT IN ('small', 'large')))), ' ') AS tokens FROM part")
def name_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(E.name_tokens(F.concat("p_name", F.lit("/"), "p_type"))), " ").alias("tokens"))


@query(
    "WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS published, CASE WHEN o_orderkey % 4 <> 0 THEN '[' || (o_orderkey % 13) || '/' || (o_custkey % 32) || ']' ELSE 'none' END AS title FROM orders), m AS (SELECT *, nullif(regexp_extract(title, '\\[([0-9]{1,2})/([0-9]{1,2})\\]', 1), '') AS mm, nullif(regexp_extract(title, '\\[([0-9]{1,2})/([0-9]{1,2})\\]', 2), '') AS dd FROM o), "
    "n AS (SELECT *, list_min(list_filter(list_transform([year(published) - 1, year(published), year(published) + 1], lambda y: try_cast(y || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE)), lambda x: x IS NOT NULL)) AS any_day, list_min(list_transform(list_filter(list_transform([year(published) - 1, year(published), year(published) + 1], lambda y: try_cast(y || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE)), lambda x: x IS NOT NULL), lambda x: (abs(x - published), x > published, x)))[3] AS best FROM m) SELECT o_orderkey, CASE WHEN mm IS NULL THEN published ELSE coalesce(best, published) END AS trading_day FROM n"
)
def trading_date_inference(spark, d):
    o = table(spark, d, "orders")
    title = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("["), (F.col("o_orderkey") % 13).cast("string"), F.lit("/"), (F.col("o_custkey") % 32).cast("string"), F.lit("]"))).otherwise("none")
    return o.select("o_orderkey", E.inferred_date(title, F.to_date("o_orderdate")).alias("trading_day"))


@query("WITH k AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN f > 0 AND o > 0 AND p > 0 THEN 'FULL' WHEN f > 0 AND o > 0 THEN 'SECTIONS_AND_THEMES' WHEN f > 0 AND p > 0 THEN 'SECTIONS_AND_STOCKS' WHEN o > 0 AND p > 0 THEN 'THEMES_AND_STOCKS' WHEN f > 0 THEN 'SECTIONS' WHEN o > 0 THEN 'THEMES' WHEN p > 0 THEN 'STOCKS' ELSE 'EMPTY' END AS family FROM k")
def daily_format_family(spark, d):
    k = table(spark, d, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"])
    f, o, p = (F.col(c) > 0 for c in "fop")
    family = F.when(f & o & p, "FULL").when(f & o, "SECTIONS_AND_THEMES").when(f & p, "SECTIONS_AND_STOCKS").when(o & p, "THEMES_AND_STOCKS").when(f, "SECTIONS").when(o, "THEMES").when(p, "STOCKS").otherwise("EMPTY")
    return k.select("o_custkey", family.alias("family"))


@query("""SELECT event_id, sha256('{"at":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","kind":"' || event_type || '","user":' || user_id || '}') AS hash FROM events""")
def canonical_hash(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.sha2(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("event_type").alias("kind"), F.col("user_id").alias("user"))), 256).alias("hash"))


@query(
    r"WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '([^ \n]+) (the|der|de) ([^ \n]+)', 0)) AS m FROM documents), c AS (SELECT lang, split_part(m, ' ', 2) AS keyword, split_part(m, ' ', 3) AS neighbour, count(*) AS n FROM w GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY lang, keyword ORDER BY n DESC, neighbour) AS place FROM c) SELECT lang, keyword, neighbour, n, place FROM r WHERE place <= 5"
)
def keyword_context(spark, d):
    w = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([^ \n]+) (the|der|de) ([^ \n]+)"), 0)).alias("m"))
    c = w.groupBy("lang", F.split("m", " ")[1].alias("keyword"), F.split("m", " ")[2].alias("neighbour")).agg(F.count("*").alias("n"))
    r = c.withColumn("place", F.row_number().over(Window.partitionBy("lang", "keyword").orderBy(F.col("n").desc(), "neighbour")).cast("long"))
    return r.where("place <= 5")


@query(
    "WITH a(alias, actor) AS (VALUES ('signup error', 'A'), ('signup', 'B'), ('error', 'C'), ('view', 'D'), ('click view', 'E')), s AS (SELECT user_id, ts::DATE AS day, string_agg(event_type, ' ' ORDER BY event_id) AS text FROM events GROUP BY 1, 2), m AS (SELECT user_id, day, unnest(regexp_extract_all(text, 'signup error|click view|signup|error|view', 0)) AS alias FROM s) SELECT user_id, day, actor, count(*) AS mentions FROM m JOIN a USING (alias) GROUP BY 1, 2, 3"
)
def actor_mentions(spark, d):
    """Longest alias first, spans not overlapping; the dictionary is a constant."""
    s = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), " ").alias("text"))
    m = s.select("user_id", "day", F.explode(F.regexp_extract_all("text", F.lit("(signup error|click view|signup|error|view)"), 1)).alias("alias"))
    actor = F.when(F.col("alias") == "signup error", "A").when(F.col("alias") == "signup", "B").when(F.col("alias") == "error", "C").when(F.col("alias") == "view", "D").otherwise("E")
    return m.groupBy("user_id", "day", actor.alias("actor")).agg(F.count("*").alias("mentions"))


# addresses of pages, written in several ways
_ADDRESS = "CASE page_id % 6 WHEN 0 THEN replace(url, 'https://', 'HTTP://') WHEN 1 THEN replace(url, 'https://', 'http://WWW.') || '/?b=2&a=x%20y&utm_source=q&ref=1' WHEN 2 THEN 'ftp://x/' || page_id WHEN 3 THEN regexp_replace(url, '^(https?://[^/]+)', '\\1:8080') || '?z=&Fbclid=3&k' WHEN 4 THEN regexp_replace(url, '^(https?://[^/]+)', '\\1:443') || '//#top' ELSE url || '?q=a+b&q=%C3%A9~' END"


@query(
    f"WITH a AS (SELECT page_id, {_ADDRESS} AS u FROM pages), p AS (SELECT page_id, regexp_extract(u, '^((?i:https?))://([^/?#:]+)(?::([0-9]+))?([^?#]*)(?:\\?([^#]*))?', ['s', 'h', 'p', 'path', 'q']) AS x FROM a), "
    "q AS (SELECT page_id, list_sort(list_filter(list_transform(list_filter(string_split(x.q, '&'), lambda y: y <> ''), lambda y: {'k': url_decode(replace(split_part(y, '=', 1), '+', ' ')), 'v': url_decode(replace(CASE WHEN contains(y, '=') THEN substr(y, strpos(y, '=') + 1) ELSE '' END, '+', ' '))}), lambda y: NOT (lower(y.k) IN ('cmpid', 'fbclid', 'gclid', 'igshid', 'ref', 'spm') OR starts_with(lower(y.k), 'utm_')))) AS kv, x FROM p) "
    "SELECT page_id, CASE WHEN x.s <> '' THEN 'https://' || regexp_replace(lower(x.h), '^www\\.', '') || CASE WHEN x.p <> '' AND x.p NOT IN ('80', '443') THEN ':' || x.p ELSE '' END || CASE WHEN regexp_replace(x.path, '/+$', '') = '' THEN '/' ELSE regexp_replace(x.path, '/+$', '') END || CASE WHEN len(kv) > 0 THEN '?' || array_to_string(list_transform(kv, lambda y: replace(url_encode(y.k), '%20', '+') || '=' || replace(url_encode(y.v), '%20', '+')), '&') ELSE '' END END AS url FROM q"
)
def article_urls(spark, d):
    """One spelling of each page's address, however it was written; null where it is none."""
    i, u = F.col("page_id") % 6, F.col("url")
    at = lambda port: F.regexp_replace(u, "^(https?://[^/]+)", f"$1:{port}")
    written = (
        F.when(i == 0, F.replace(u, F.lit("https://"), F.lit("HTTP://"))).when(i == 1, F.concat(F.replace(u, F.lit("https://"), F.lit("http://WWW.")), F.lit("/?b=2&a=x%20y&utm_source=q&ref=1")))
        .when(i == 2, F.concat(F.lit("ftp://x/"), F.col("page_id").cast("string"))).when(i == 3, F.concat(at(8080), F.lit("?z=&Fbclid=3&k"))).when(i == 4, F.concat(at(443), F.lit("//#top"))).otherwise(F.concat(u, F.lit("?q=a+b&q=%C3%A9~")))
    )
    return table(spark, d, "pages").select("page_id", T.article_url(written).alias("url"))
