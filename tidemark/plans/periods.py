"""Questions made of orders (their day and number), and what days, periods and amounts they ask for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import periods as P
from ..sources.tables import table
from .queries import query

#: {y}: the order's year; {m} from 0 to 13, {d} from 0 to 32 (so not always a day), {k} from 0 to 13, {n} a number.
QUESTIONS = (
    "{y}년 {m}월 {d}일 오른 종목", "{y}-{m}-{d} 급등", "지난 수요일 하락 이유", "전 거래일 상승 테마", "그저께와 어제 비교", "{m}월 {d}일 반도체", "{m}/{d} 주가", "{y}년 {m}월 수주", "최근 {k}일 급등", "최근 {k}주 하락",
    "최근 {k}개월 수주액 {n}억원 이상", "최근 {k}년 {n}조 넘는 계약", "이번 주와 지난달", "올해 과거 작년 역대", "{y}년 테마", "2015 이후 최근 일주일 {n}.5만원 미만", "{m}월 {d}일부터 {y}.{m}.{d}까지", "오늘 {n}원 이하 {n}천만원 초과", "최근 한 달 지난 주 여태",
)
_LIST = "[" + ", ".join(f"'{q}'" for q in QUESTIONS) + "]"
_TEXTS = f"""tx AS (SELECT o_orderkey AS id, o_orderdate::DATE + 40 AS today, replace(replace(replace(replace(replace(({_LIST})[o_orderkey % {len(QUESTIONS)} + 1], '{{y}}', year(o_orderdate)::VARCHAR), '{{m}}', (o_orderkey % 14)::VARCHAR), '{{d}}', (o_orderkey % 33)::VARCHAR), '{{k}}', (o_custkey % 14)::VARCHAR), '{{n}}', (o_custkey % 997)::VARCHAR) AS text FROM orders)"""
# (place, kind, name, pattern without look-around, what may not go before and after)
_SQL_PATTERNS = {
    r"(?<![0-9])(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?![0-9])": (r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})", "[0-9]", "[0-9]"),
    r"(?<![0-9])(\d{1,2})\s*월\s*(\d{1,2})\s*일": (r"(\d{1,2})\s*월\s*(\d{1,2})\s*일", "[0-9]", None),
    r"(?<![0-9./-])(\d{1,2})[/.](\d{1,2})(?![0-9./-])": (r"(\d{1,2})[/.](\d{1,2})", "[0-9./-]", "[0-9./-]"),
    r"(?<![0-9])(\d{4})\s*년": (r"(\d{4})\s*년", "[0-9]", None),
    r"(?<![0-9])(19[5-9]\d|20\d{2})(?![0-9])": (r"(19[5-9]\d|20\d{2})", "[0-9]", "[0-9]"),
}


def _matches() -> str:
    out = []
    for place, (kind, name, pattern) in enumerate(P._ALL):
        if "\\" not in pattern:
            out.append(f"SELECT id, today, text, {place} AS place, '{kind}' AS kind, '{name}' AS name, strpos(text, '{pattern}') - 1 AS s, '{pattern}' AS lit, NULL::INT AS a, NULL::INT AS b, NULL::INT AS c FROM tx WHERE contains(text, '{pattern}')")
            continue
        plain, before, after = _SQL_PATTERNS.get(pattern, (pattern, None, None))
        anchored = f"^({plain})" + (f"(?:[^{after[1:-1]}]|$)" if after else "")
        groups = plain.replace("(?:", "").count("(")
        number = lambda i: f"try_cast(regexp_extract(rest, '{anchored}', {i}) AS INT)" if i <= groups + 1 else "NULL::INT"  # noqa: B023, E731
        guard = f" AND NOT (s > 0 AND regexp_matches(substr(text, s, 1), '{before}'))" if before else ""
        out.append(f"SELECT id, today, text, {place}, '{kind}', '{name}', s, regexp_extract(rest, '{anchored}', 1), {number(2)}, {number(3)}, {number(4)} FROM at_ WHERE regexp_matches(rest, '{anchored}'){guard}")
    return " UNION ALL ".join(out)


_DAY = "try_strptime(lpad({y}::VARCHAR, 4, '0') || '-' || {m}::VARCHAR || '-' || {d}::VARCHAR, '%Y-%m-%d')::DATE"
_WEEK = " ".join(f"WHEN 'LAST_{w}' THEN today - (CASE WHEN (isodow(today) - {i} + 7) % 7 = 0 THEN 7 ELSE (isodow(today) - {i} + 7) % 7 END)::INT" for i, w in enumerate(("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY"), 1))
_MD, _MD_OLD, _YM = _DAY.format(y="year(today)", m="a", d="b"), _DAY.format(y="(year(today) - 1)", m="a", d="b"), _DAY.format(y="a", m="b", d="1")
_SQL = rf"""{_TEXTS}, at_ AS (SELECT *, substr(text, s + 1) AS rest FROM (SELECT *, unnest(range(length(text)::BIGINT)) AS s FROM tx)), mt(id, today, text, place, kind, name, s, lit, a, b, c) AS ({_matches()}),
bd AS (SELECT *, s + length(lit) AS e, CASE name WHEN 'YMD' THEN {_DAY.format(y="a", m="b", d="c")} WHEN 'PREVIOUS_TRADING_DAY' THEN today - 1 WHEN 'DAY_BEFORE_YESTERDAY' THEN today - 2 WHEN 'YESTERDAY' THEN today - 1 WHEN 'TODAY' THEN today {_WEEK}
    WHEN 'MD' THEN CASE WHEN {_MD} > today THEN coalesce({_MD_OLD}, {_MD}) ELSE {_MD} END WHEN 'YM' THEN {_YM} WHEN 'RECENT_DAYS' THEN CASE WHEN a > 0 THEN today - (a - 1) END WHEN 'RECENT_WEEKS' THEN CASE WHEN a > 0 THEN today - (a * 7 - 1) END
    WHEN 'RECENT_MONTHS' THEN CASE WHEN a > 0 THEN (today - to_months(a))::DATE + 1 END WHEN 'RECENT_YEARS' THEN CASE WHEN a > 0 THEN (today - to_months(a * 12))::DATE + 1 END WHEN 'LAST_7_DAYS' THEN today - 6 WHEN 'THIS_WEEK' THEN date_trunc('week', today)::DATE
    WHEN 'LAST_WEEK' THEN date_trunc('week', today)::DATE - 7 WHEN 'THIS_MONTH' THEN date_trunc('month', today)::DATE WHEN 'LAST_MONTH' THEN (date_trunc('month', today) - INTERVAL 1 MONTH)::DATE WHEN 'THIS_YEAR' THEN date_trunc('year', today)::DATE
    WHEN 'LAST_YEAR' THEN make_date(year(today) - 1, 1, 1) WHEN 'RECENT' THEN today - 89 WHEN 'ALL_TIME' THEN DATE '2007-01-01' WHEN 'Y' THEN {_DAY.format(y="a", m="1", d="1")} END AS f FROM mt),
b2 AS (SELECT *, CASE WHEN kind = 'DATE' THEN f WHEN name = 'YM' THEN last_day(f) WHEN name = 'LAST_WEEK' THEN f + 6 WHEN name = 'LAST_MONTH' THEN last_day(f) WHEN name = 'LAST_YEAR' THEN make_date(year(f), 12, 31) WHEN name = 'Y' THEN make_date(year(f), 12, 31) ELSE today END AS t,
  CASE WHEN name = 'RECENT_DAYS' THEN CASE WHEN a = 7 THEN 'LAST_7_DAYS' ELSE 'RECENT' END WHEN name = 'RECENT_WEEKS' THEN CASE WHEN a = 1 THEN 'LAST_7_DAYS' ELSE 'RECENT' END WHEN name = 'RECENT_MONTHS' THEN CASE a WHEN 1 THEN 'LAST_MONTH' WHEN 3 THEN 'LAST_3_MONTHS' WHEN 12 THEN 'LAST_12_MONTHS' ELSE 'RECENT' END
    WHEN name = 'RECENT_YEARS' THEN CASE WHEN a = 1 THEN 'LAST_12_MONTHS' ELSE 'RECENT' END WHEN name IN ('YMD', 'MD', 'YM', 'Y') THEN NULL ELSE name END AS expression FROM bd WHERE f IS NOT NULL),
nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place, s) AS n FROM b2),
cl(id, n, taken, mine) AS (SELECT DISTINCT id, 0::BIGINT, []::STRUCT(s BIGINT, e BIGINT)[], FALSE FROM nn UNION ALL SELECT nn.id, nn.n, CASE WHEN len(list_filter(taken, lambda x: x.s < nn.e AND nn.s < x.e)) = 0 THEN list_append(taken, {{'s': nn.s::BIGINT, 'e': nn.e::BIGINT}}) ELSE taken END, len(list_filter(taken, lambda x: x.s < nn.e AND nn.s < x.e)) = 0 FROM cl JOIN nn ON nn.id = cl.id AND nn.n = cl.n + 1),
iv AS (SELECT nn.* FROM nn JOIN cl USING (id, n) WHERE mine)"""


def _questions(spark, d):
    # a file's row group is one task: orders are spread before their questions are made
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition("o_orderkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sentence = F.get(F.array(*map(F.lit, QUESTIONS)), (k % len(QUESTIONS)).cast("int"))
    parts = (("{y}", F.year("o_orderdate")), ("{m}", k % 14), ("{d}", k % 33), ("{k}", c % 14), ("{n}", c % 997))
    text = reduce(lambda t, x: F.replace(t, F.lit(x[0]), x[1].cast("string")), parts, sentence)
    return o.select(k.alias("text_id"), F.date_add(F.to_date("o_orderdate"), 40).alias("today"), text.alias("text"))


@query(f"WITH RECURSIVE {_SQL} SELECT id AS order_id, s AS start, e AS end_at, kind, lit AS literal, expression, f AS from_day, t AS to_day FROM iv")
def asked_intervals(spark, d):
    """Every day and period that questions name, with its offsets."""
    i = P.intervals(_questions(spark, d))
    return i.select(F.col("text_id").alias("order_id"), "start", F.col("end").alias("end_at"), "kind", "literal", "expression", "from_day", "to_day")


@query(
    f"WITH RECURSIVE {_SQL}, g AS (SELECT id, count(*) FILTER (kind = 'DATE') AS days, min(f) FILTER (kind = 'DATE') AS a, max(t) FILTER (kind = 'DATE') AS b, arg_min(f, s) FILTER (kind = 'PERIOD') AS pf, arg_min(t, s) FILTER (kind = 'PERIOD') AS pt FROM iv GROUP BY 1), "
    r"am AS (SELECT id, regexp_extract(text, '(\d+(?:[.,]\d+)?)\s*(조원|조|억원|억|천만원|백만원|만원|원)\s*(이상|초과|넘는|넘은|넘게|이하|미만)?', ['x', 'u', 'c']) AS m FROM tx) "
    "SELECT tx.id AS order_id, CASE WHEN days > 0 THEN a ELSE pf END AS from_day, CASE WHEN days > 0 THEN b ELSE pt END AS to_day, CASE WHEN days > 1 THEN 'DATES' WHEN days = 1 THEN 'DATE' WHEN days = 0 THEN 'PERIOD' END AS asked, "
    "CASE WHEN m.x <> '' THEN CASE WHEN m.c IN ('초과', '넘는', '넘은', '넘게') THEN 'GT' WHEN m.c = '이하' THEN 'LTE' WHEN m.c = '미만' THEN 'LT' ELSE 'GTE' END END AS comparator, "
    "CASE WHEN m.x <> '' THEN replace(m.x, ',', '')::DOUBLE * CASE m.u WHEN '조원' THEN 1000000000000 WHEN '조' THEN 1000000000000 WHEN '억원' THEN 100000000 WHEN '억' THEN 100000000 WHEN '천만원' THEN 10000000 WHEN '백만원' THEN 1000000 WHEN '만원' THEN 10000 ELSE 1 END END AS amount FROM tx LEFT JOIN g ON g.id = tx.id LEFT JOIN am ON am.id = tx.id"
)
def asked_ranges(spark, d):
    """The range and the amount that each question asks for."""
    q = _questions(spark, d)
    x = q.select("text_id", P.amount(F.col("text")).alias("m")).join(P.asked_range(P.intervals(q)), "text_id", "left")
    return x.select(F.col("text_id").alias("order_id"), "from_day", "to_day", "asked", F.col("m.comparator").alias("comparator"), F.col("m.value").cast("double").alias("amount"))
