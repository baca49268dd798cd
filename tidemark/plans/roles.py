"""Company names and their roles: parts as companies (names with validity), orders as sentences about the parts of their first three lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators import roles as R
from ..sources.tables import table
from .queries import query

#: Sentences by order number; {a}, {b} and {c} are names of the parts of the first three lines ('' where there are fewer).
SENTENCES = (
    "{a}가 {b}와 공급계약 체결. {c} 수혜",
    "{a}, {b} 인수 추진, {c} 피해 우려",
    "{a} 유상증자 결정 및 규제 강화에 따른 {b} 수혜",
    "{a} 압수수색 소식; {b} 반사수혜",
    "최선호주로 {a} 선정, {b}도 투자 결정",
    "{a}과 {b}, 공동 개발 합의",
    "{a} 투자심리 위축 {b} 타격",
    "고객 피해 {a} 비용 부담 {b} 영업이익 전망 상회",
    "{a} 측과의 업무협약 체결 {b} 주식분할",
    "{a} 상장 흥행 {b} 상장 추진",
    "{a}로부터 수주 {b}, {c} 인수 완료",
    "{a} 회장 발표 {b} 실적 발표",
    "X{a} 공개 {b}은 신제품 출시\n{c} 공시",
    "{a} 규제 대상 {b} 제재 {c} 감산 수혜",
    "{a}에 따른 수혜 {b} 손실",
    "{a} 후보 선정 {b} 협력 {c} 매각 결정",
    "{a}는 {b}, {c} 편입 결정 및 {a} 배당",
    "{a} {b} {c} 실적 발표 컨센서스 하회 {a} 공시",
)

_LIST = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SENTENCES) + "]"
# full names are valid in one year of seven, short ones (of the first 40 parts) always
_ALIASES = """al AS (SELECT p_name || ' ' || p_type AS alias, lpad(p_partkey::VARCHAR, 6, '0') AS code, make_date(1995 + p_partkey % 7, 1, 1) AS f, make_date(1995 + p_partkey % 7, 12, 31) AS t, p_size > 5 AS known FROM part
  UNION ALL SELECT p_name, lpad(p_partkey::VARCHAR, 6, '0'), NULL, NULL, p_size > 5 FROM part WHERE p_partkey < 40),
same AS (SELECT *, regexp_replace(lower(alias), '\\s+|\\(주\\)|㈜|주식회사', '', 'g') AS norm FROM al)"""
_TEXTS = f"""ln AS (SELECT l_orderkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_type ELSE p_name END AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem JOIN part ON p_partkey = l_partkey),
abc AS (SELECT l_orderkey, coalesce(max(name) FILTER (i = 1), '') AS a, coalesce(max(name) FILTER (i = 2), '') AS b, coalesce(max(name) FILTER (i = 3), '') AS c FROM ln GROUP BY 1),
txt AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, replace(replace(replace(({_LIST})[o_orderkey % {len(SENTENCES)} + 1], '{{a}}', a), '{{b}}', b), '{{c}}', c) AS text FROM orders JOIN abc ON l_orderkey = o_orderkey)"""
# every place of every name that stands there, then from left to right the longest that begins at or after the last one's end
_FOUND = r"""sp AS (SELECT DISTINCT lower(alias) AS name, norm FROM same),
cand AS (SELECT id, name, norm, text, day, unnest(list_filter(range(length(text)::BIGINT), lambda i: substr(lower(text), i + 1, length(name)) = name)) AS s FROM txt JOIN sp ON contains(lower(text), name)),
ok AS (SELECT *, s + length(name) AS e FROM cand WHERE (s = 0 OR NOT regexp_matches(substr(text, s, 1), '[\p{L}\p{N}]')) AND (NOT regexp_matches(substr(text, s + length(name) + 1, 1), '[\p{L}\p{N}]') OR regexp_matches(substr(text, s + length(name) + 1, 1), '[은는이가을를와과의도에로]'))),
far AS (SELECT id, s, max(e) AS e FROM ok GROUP BY 1, 2),
pick(id, s, e) AS (SELECT DISTINCT id, -1::BIGINT, 0::BIGINT FROM far UNION ALL SELECT id, s, e FROM (SELECT p.id, c.s, c.e, row_number() OVER (PARTITION BY p.id ORDER BY c.s) AS n FROM pick p JOIN far c ON c.id = p.id AND c.s >= p.e) WHERE n = 1),
men0 AS (SELECT ok.* FROM ok JOIN pick USING (id, s, e)),
stat AS (SELECT id, s, e, any_value(name) AS name, any_value(text) AS text, count(same.code) AS valid, count(DISTINCT same.code) AS codes, coalesce(bool_or(known), FALSE) AS known, min(same.code) AS code
  FROM men0 LEFT JOIN same ON same.norm = men0.norm AND coalesce(f <= day, TRUE) AND coalesce(t >= day, TRUE) GROUP BY 1, 2, 3),
men AS (SELECT id, s, e, text, name, CASE WHEN codes = 0 THEN 'OUT_OF_VALIDITY' WHEN codes > 1 THEN 'AMBIGUOUS_ALIAS' WHEN known THEN 'RESOLVED' ELSE 'UNKNOWN_STOCK_CODE' END AS status, CASE WHEN codes = 1 AND known THEN code END AS code FROM stat)"""


def _values(kind: str, markers: tuple) -> str:
    return ", ".join(f"('{kind}', '{m}', {R.WITHIN[kind]})" for m in sorted(set(markers)))


_MARKERS = ", ".join(
    _values(k, m)
    for k, m in (("contract", R.CONTRACT), ("collaboration", (*R.CONTRACT, *R.COLLABORATION)), ("issuer", R.ISSUER), ("action", R.ACTION), ("passive", R.PASSIVE), ("regulatory", R.REGULATORY), ("acquisition", R.ACQUISITION), ("selection", R.SELECTION), ("benefit", R.BENEFIT), ("adverse", R.ADVERSE))
)
_CP, _PRE, _DIR, _RO = (p.replace("'", "''") for p in (R.COUNTERPARTY, R.PREFIX, R.DIRECT, R.TRAILING_RO))
# every marker after every name at its first place that isn't misleading; the first of each kind, the longest on ties
_EVENTS = rf"""live AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS place FROM men WHERE NOT regexp_matches(substr(text, e + 1, 10), '^\s*(?:美|미국|인도|중국|유럽)?\s*(?:부회장|회장|사장|대표이사|의장|자회사|(?:판매)?법인(?:[^세]|$))')),
lim AS (SELECT *, e + CASE WHEN regexp_matches(substr(text, e + 1), '[.!?;。\n]') THEN length(regexp_extract(substr(text, e + 1), '^[^.!?;。\n]*')) ELSE length(text) - e END AS stop FROM live),
par AS (SELECT *, CASE WHEN contains(substr(text, e + 1), ' 및 ') THEN least(stop, e + strpos(substr(text, e + 1), ' 및 ') - 1) ELSE stop END AS part FROM lim),
mk(kind, m, within) AS (VALUES {_MARKERS}),
hits AS (SELECT id, s, kind, m, list_min(list_filter(range(e, least(CASE WHEN kind IN ('contract', 'collaboration', 'issuer', 'action') THEN stop ELSE part END, e + within) - length(m) + 1), lambda i: substr(text, i + 1, length(m)) = m
    AND NOT (m = '투자' AND substr(text, i + 3, 2) = '심리') AND NOT (starts_with(m, '피해') AND regexp_matches(substr(text, greatest(i - 9, 1), i - greatest(i - 9, 1) + 1), '2차|이용자|고객|소비자|가입자|소액결제'))
    AND NOT (m IN ('호실적', '실적 발표', '잠정 실적', '영업이익', '매출액') AND regexp_matches(substr(text, i + length(m) + 1, 10), '전망|기대|컨센서스|우려|영향|하회')) AND NOT (m = '상장' AND starts_with(ltrim(substr(text, i + 3, 4)), '흥행')))) AS pos
  FROM par JOIN mk ON contains(substr(text, e + 1, within), m)),
ev AS (SELECT id, s, kind, pos, pos + length(m) AS til FROM (SELECT *, row_number() OVER (PARTITION BY id, s, kind ORDER BY pos, length(m) DESC) AS n FROM hits WHERE pos IS NOT NULL) WHERE n = 1),
x AS (SELECT v.*, h.e, h.text, h.status, substr(text, h.e + 1, pos - h.e) AS gap, NOT EXISTS (SELECT 1 FROM live o WHERE o.id = v.id AND o.s >= h.e AND o.s < v.pos) AS free,
  regexp_matches(substr(text, 1, v.s), '{_RO}') AS after_ro FROM ev v JOIN live h ON h.id = v.id AND h.s = v.s),
claim AS (SELECT x.id, x.s, x.kind FROM x JOIN live o ON o.id = x.id AND o.s >= x.e AND o.s < x.pos WHERE NOT (regexp_matches(gap, '{_PRE}') AND pos - o.e <= 12 AND regexp_matches(substr(x.text, pos + 1), '^(인수|매각|편입)'))
  AND (regexp_matches(substr(x.text, o.e + 1, greatest(pos - o.e, 0)), '{_PRE}') OR NOT regexp_matches(substr(x.text, o.e + 1, greatest(pos - o.e, 0)), '{_CP}') AND pos - o.e <= 12)),
subj AS (SELECT x.*, NOT regexp_matches(gap, '{_CP}') AND (regexp_matches(gap, '{_PRE}') OR regexp_matches(gap, '{_DIR}') OR pos - e <= 12 AND NOT after_ro AND NOT regexp_matches(gap, '{_RO}')) AND (id, s, kind) NOT IN (SELECT id, s, kind FROM claim) AS is_subject FROM x),
cp AS (SELECT id, s, pos, til FROM subj WHERE kind = 'collaboration' AND NOT contains(gap, '공동') AND NOT regexp_matches(gap, '^\s*(?:측\s*)?(?:와|과)(?:의)?\s*[가-힣A-Za-z0-9·]+\s*,') AND regexp_matches(gap, '{_CP}')),
pre AS (SELECT DISTINCT h.id, h.s FROM live h JOIN live o ON o.id = h.id AND o.e <= h.s WHERE regexp_matches(substr(h.text, o.e + 1, h.s - o.e), '{_PRE}') OR regexp_matches(substr(h.text, o.e + 1, h.s - o.e), '{_DIR}')),
tg0 AS (SELECT subj.*, row_number() OVER (PARTITION BY id, s ORDER BY CASE kind WHEN 'acquisition' THEN 1 WHEN 'passive' THEN 2 WHEN 'regulatory' THEN 3 ELSE 4 END) AS n FROM subj WHERE kind IN ('passive', 'regulatory') OR kind = 'acquisition' AND (id, s) IN (SELECT id, s FROM pre)
  OR kind = 'selection' AND (after_ro OR regexp_matches(gap, '{_RO}') OR ends_with(trim(substr(text, greatest(pos - 3, 1), pos - greatest(pos - 3, 1) + 1)), '후보'))),
tg AS (SELECT id, s, pos, til FROM tg0 WHERE n = 1 AND free),
iss AS (SELECT id, s, pos, til FROM subj WHERE kind = 'issuer' AND is_subject),
con AS (SELECT id, s, pos, til FROM subj WHERE kind = 'contract' AND is_subject AND (id, s) NOT IN (SELECT id, s FROM cp) AND (id, s) NOT IN (SELECT id, s FROM tg)),
act AS (SELECT a.id, a.s, a.pos, a.til FROM subj a LEFT JOIN iss i ON i.id = a.id AND i.s = a.s WHERE kind = 'action' AND is_subject AND (a.id, a.s) NOT IN (SELECT id, s FROM cp) AND (a.id, a.s) NOT IN (SELECT id, s FROM tg) AND NOT coalesce(a.pos < i.til AND i.pos < a.til, FALSE)),
ben AS (SELECT b.id, b.s, b.pos, b.til FROM subj b WHERE kind = 'benefit' AND free AND NOT contains(gap, '따른') AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM act UNION ALL SELECT * FROM con UNION ALL SELECT * FROM iss) r WHERE r.id = b.id AND r.s = b.s AND r.pos < b.pos)),
adv AS (SELECT id, s, pos, til FROM subj WHERE kind = 'adverse' AND free),
ro AS (SELECT id, s, 'ACTOR' AS role, til FROM act UNION ALL SELECT id, s, 'ISSUER', til FROM iss UNION ALL SELECT id, s, 'CONTRACTOR', til FROM con UNION ALL SELECT id, s, 'COUNTERPARTY', til FROM cp UNION ALL SELECT id, s, 'TARGET', til FROM tg UNION ALL SELECT id, s, 'BENEFICIARY', til FROM ben UNION ALL SELECT id, s, 'ADVERSELY_AFFECTED', til FROM adv)"""


def _aliases(spark, d):
    p = table(spark, d, "part")
    code, known, year = F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.col("p_size") > 5, (1995 + F.col("p_partkey") % 7).cast("int")
    full = p.select(F.concat_ws(" ", "p_name", "p_type").alias("alias"), code.alias("code"), F.make_date(year, F.lit(1), F.lit(1)).alias("valid_from"), F.make_date(year, F.lit(12), F.lit(31)).alias("valid_to"), known.alias("known"))
    day = F.lit(None).cast("date")
    return full.unionByName(p.where("p_partkey < 40").select(F.col("p_name").alias("alias"), code.alias("code"), day.alias("valid_from"), day.alias("valid_to"), known.alias("known")))


def _texts(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.col("p_name")).alias("name"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").join(p, F.col("l_partkey") == F.col("p_partkey"))
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    abc = l.withColumn("i", i).groupBy("l_orderkey").agg(*[F.coalesce(F.max(F.when(F.col("i") == k, F.col("name"))), F.lit("")).alias(x) for k, x in ((1, "a"), (2, "b"), (3, "c"))])
    o = table(spark, d, "orders").join(abc, F.col("o_orderkey") == F.col("l_orderkey"))
    sentence = F.get(F.array(*map(F.lit, SENTENCES)), (F.col("o_orderkey") % len(SENTENCES)).cast("int"))
    text = reduce(lambda t, x: F.replace(t, F.lit(f"{{{x}}}"), F.col(x)), "abc", sentence)
    return o.select(F.col("o_orderkey").alias("text_id"), text.alias("text"), F.to_date("o_orderdate").alias("as_of"))


@query(f"WITH RECURSIVE {_ALIASES}, {_TEXTS}, {_FOUND} SELECT id AS order_id, s AS start, e AS end_at, name, status, code FROM men")
def company_mentions(spark, d):
    """Names of the dictionary in sentences, and what they resolve to on the day."""
    m = D.mentions(_texts(spark, d), _aliases(spark, d)).select("text_id", F.explode("spans").alias("x"))
    return m.select(F.col("text_id").alias("order_id"), "x.start", F.col("x.end").alias("end_at"), "x.name", "x.status", "x.code")


@query(
    f"WITH RECURSIVE {_ALIASES}, {_TEXTS}, {_FOUND}, {_EVENTS} SELECT l.id AS order_id, l.place, substr(l.text, l.s + 1, l.e - l.s) AS mention_text, l.status, l.code, ro.role, l.s AS start, ro.til AS end_at FROM live l LEFT JOIN ro ON ro.id = l.id AND ro.s = l.s AND l.status = 'RESOLVED'"
)
def company_roles(spark, d):
    """Roles of every name of every sentence, with the evidence's span; a name without a role has one row."""
    r = R.body_roles(_texts(spark, d), _aliases(spark, d)).withColumn("x", F.explode_outer("roles"))
    return r.select(F.col("text_id").alias("order_id"), "place", "mention_text", "status", "code", "x.role", "start", F.col("x.end").alias("end_at"))


_REFS = """refs AS (SELECT l_orderkey AS order_id, CASE WHEN l_linenumber <= 2 THEN 'LEADER_LIST' ELSE 'MEMBERSHIP' END AS kind, l_linenumber AS place, p_name AS name, CASE l_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'K' || l_partkey ELSE lpad((l_partkey * 2 % 3000)::VARCHAR, 6, '0') END AS code, CASE WHEN l_suppkey % 13 = 0 THEN 'CODE_INVALID' ELSE 'OK' END AS quality FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(
    f"WITH {_ALIASES}, {_REFS}, k AS (SELECT code, bool_or(known) AS known FROM al GROUP BY 1), x AS (SELECT refs.*, CASE WHEN refs.code IS NULL THEN 'SOURCE_CODE_MISSING' WHEN NOT regexp_full_match(refs.code, '[0-9]{{6}}') OR quality = 'CODE_INVALID' THEN 'CODE_INVALID' WHEN known THEN 'RESOLVED' ELSE 'UNKNOWN_STOCK_CODE' END AS status FROM refs LEFT JOIN k ON k.code = refs.code) "
    "SELECT order_id, kind, place, name AS mention_text, status, CASE WHEN status = 'RESOLVED' THEN code END AS code, CASE kind WHEN 'LEADER_LIST' THEN 'LEADER' ELSE 'RELATED' END AS suggested_role, CASE WHEN status = 'RESOLVED' THEN CASE kind WHEN 'LEADER_LIST' THEN 'LEADER' ELSE 'RELATED' END END AS role FROM x"
)
def company_list_roles(spark, d):
    """Leaders and members as orders list them: roles from the list, statuses from the code."""
    k = F.col("l_partkey")
    code = F.when(k % 11 == 0, None).when(k % 11 == 1, F.concat(F.lit("K"), k.cast("string"))).otherwise(F.lpad((k * 2 % 3000).cast("string"), 6, "0"))
    l = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_name"), k == F.col("p_partkey"))
    refs = l.select(F.col("l_orderkey").alias("text_id"), F.when(F.col("l_linenumber") <= 2, "LEADER_LIST").otherwise("MEMBERSHIP").alias("kind"), F.col("l_linenumber").alias("place"), F.col("p_name").alias("name"), code.alias("code"), F.when(F.col("l_suppkey") % 13 == 0, "CODE_INVALID").otherwise("OK").alias("quality"))
    return R.listed_roles(refs, _aliases(spark, d), "[0-9]{6}").withColumnRenamed("text_id", "order_id")
