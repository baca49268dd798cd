"""Amounts in sentences about orders: price and number of an order in sentences of several forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import values as V
from ..sources.tables import table
from .queries import query

#: {n}: the order's price in whole units, with a comma in every second order; {k}: a number from 1 to 97.
SENTENCES = (
    "{k}조 {n}억원 규모 공급계약 체결",
    "{k}조,{n}억 달러 투자",
    "{k}억 {n}만 달러 수주",
    "약 {n}억원 투자 결정",
    "{n}억원(최근 매출액대비 {k}%) 규모 수주",
    "매출액 {n}억원 공급",
    "지분 {k}.5% 취득, 주가가 크게 움직인 뒤 나온 소식에 {k}% 상승(+{k}% 보유)",
    "{k}GW 설비와 {k}만 {n}톤 생산",
    "전기차 {n}대 공급, 세계 {k}대 시장",
    "{n}억원 계약 해지",
    "{k}억원 계약, 총사업비 {n}억원 계약",
    "회사 몫 {n}만원 계약 및 {k}개 분야",
    "최대 {n}원대 투자와 {k}개 게임사",
    "전력 {k}GW 부족 전망 속에 발전소 {n}MW 이상 공급",
    "{n}유로에서 {k}억유로까지 투자",
    "공급망 투자 {n}엔 증자 검토, 이어 나온 공장 건설에 {k}억엔 투자",
)
_LIST = "[" + ", ".join(f"'{s}'" for s in SENTENCES) + "]"
_END = "(?:[^가-힣A-Za-z0-9]|$)"
# number, claim group, whether a digit or comma may not go before, pattern with its end
_PATTERNS = (
    (0, "KRW_COMPOUND", "money", False, rf"^((\d+(?:\.\d+)?)\s*조\s*(\d[\d,]*)\s*억\s*(원)(?:대)?){_END}"),
    (1, "JO_FOREIGN", "money", False, rf"^((\d+(?:\.\d+)?)\s*조\s*,?\s*(\d[\d,]*)\s*억\s*(달러|유로|엔)(?:대)?){_END}"),
    (2, "EOK_FOREIGN", "money", False, rf"^((\d[\d,]*(?:\.\d+)?)\s*억\s*(\d[\d,]*(?:\.\d+)?)\s*만\s*(달러|유로|엔)(?:대)?){_END}"),
    (3, "MONEY", "money", False, rf"^((\d[\d,]*(?:\.\d+)?)\s*(조|억|만)?\s*(원|달러|유로|엔)(?:대)?){_END}"),
    (4, "PERCENT", "percent", False, r"^((\d+(?:\.\d+)?)\s*%)()()"),
    (5, "TON_COMPOUND", "capacity", True, rf"^((\d[\d,]*(?:\.\d+)?)\s*만\s*(\d[\d,]*(?:\.\d+)?)\s*(톤)){_END}"),
    (6, "CAPACITY", "capacity", True, rf"^((\d[\d,]*(?:\.\d+)?)\s*()(GW|MW|톤)){_END}"),
    (7, "QUANTITY", "quantity", True, rf"^((\d[\d,]*)\s*()(대|기|개)){_END}"),
)
_MATCHES = " UNION ALL ".join(
    f"SELECT id, text, s, {k} AS k, '{n}' AS name, '{g}' AS claims, regexp_extract(rest, '{p}', 1) AS reported, regexp_extract(rest, '{p}', 2) AS a, regexp_extract(rest, '{p}', 3) AS b, regexp_extract(rest, '{p}', 4) AS u FROM st WHERE regexp_matches(rest, '{p}')"
    + (" AND NOT (s > 0 AND regexp_matches(substr(text, s, 1), '[0-9,]'))" if apart else "")
    for k, n, g, apart, p in _PATTERNS
)
_TEXTS = f"""tx AS (SELECT o_orderkey AS id, replace(replace(({_LIST})[o_orderkey % {len(SENTENCES)} + 1], '{{k}}', (o_orderkey % 97 + 1)::VARCHAR), '{{n}}', CASE WHEN o_orderkey // {len(SENTENCES)} % 2 = 0 THEN n ELSE n[:-4] || ',' || n[-3:] END) AS text FROM (SELECT *, (1000 + floor(o_totalprice))::BIGINT::VARCHAR AS n FROM orders))"""
_SQL = rf"""WITH {_TEXTS}, st AS (SELECT *, substr(text, s + 1) AS rest FROM (SELECT id, text, unnest(list_filter(range(length(text)), lambda i: regexp_matches(substr(text, i + 1, 1), '[0-9]'))) AS s FROM tx)),
m0 AS ({_MATCHES}),
m1 AS (SELECT *, s + length(reported) AS e, row_number() OVER (PARTITION BY id, k, s + length(reported) ORDER BY s) AS first FROM m0),
m2 AS (SELECT *, substr(text, greatest(s - 43, 1), s - greatest(s - 43, 1) + 1) AS l, substr(text, e + 1, 44) AS r FROM m1 WHERE first = 1),
m3 AS (SELECT *, right(l, 16) || reported || left(r, 12) AS near, regexp_replace(l, '\([^)]*\)', '', 'g') AS bf, regexp_replace(r, '\([^)]*\)', '', 'g') AS af FROM m2),
m4 AS (SELECT *, replace(right(bf, 28) || '|' || left(af, 36), '공급망', '') AS w, length(right(bf, 28)) AS pv FROM m3),
dl AS (SELECT m4.id, m4.k, m4.s, fact, unnest(list_filter(range(length(w)), lambda i: substr(w, i + 1, length(d.m)) = d.m)) AS i, length(d.m) AS len, pv FROM m4, (VALUES ('CONTRACT_VALUE', '계약'), ('CONTRACT_VALUE', '수주'), ('CONTRACT_VALUE', '공급'), ('CONTRACT_VALUE', '납품'), ('INVESTMENT_VALUE', '투자')) d(fact, m) WHERE claims = 'money'),
de AS (SELECT id, k, s, arg_min(fact, (CASE WHEN i < pv THEN pv - i - len ELSE i - pv END, fact)) AS deal FROM dl WHERE CASE WHEN i < pv THEN pv - i - len ELSE i - pv END <= 18 GROUP BY 1, 2, 3),
m5 AS (SELECT m4.*, CASE WHEN claims = 'money' THEN CASE WHEN NOT regexp_matches(right(bf, 16), '시총|시가총액|기업가치|매출액|영업이익|주가') AND NOT regexp_matches(right(bf, 12) || left(af, 16), '증자|자금조달|투자 계획') THEN deal END
  WHEN name = 'PERCENT' THEN CASE WHEN right(l, 2) NOT IN ('(+', '(-') AND regexp_matches(near, '지분|보유|인수|매각|취득|처분') THEN 'STAKE_PERCENT' END
  WHEN claims = 'capacity' THEN CASE WHEN name = 'TON_COMPOUND' OR NOT regexp_matches(right(l, 12) || reported || left(r, 12), '이탈|부족') THEN 'CAPACITY' END
  WHEN NOT regexp_matches(left(r, 12), '^\s*(?:공약|과제|그룹|메가|분야|시도|연속|최고|미만|이상|이하|초반|중반|후반|신도시)') AND right(l, 1) <> '제' AND NOT (u = '대' AND regexp_matches(right(l, 4), '세계|국내|글로벌|아시아')) THEN 'QUANTITY' END AS fact
  FROM m4 LEFT JOIN de ON de.id = m4.id AND de.k = m4.k AND de.s = m4.s),
m6 AS (SELECT * FROM m5 x WHERE fact IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m5 o WHERE o.fact IS NOT NULL AND o.id = x.id AND o.claims = x.claims AND o.claims IN ('money', 'capacity') AND o.k < x.k AND o.s < x.e AND x.s < o.e)),
m7 AS (SELECT *, replace(a, ',', '')::DECIMAL(30, 6) AS x, CASE WHEN name IN ('KRW_COMPOUND', 'JO_FOREIGN', 'EOK_FOREIGN', 'TON_COMPOUND') THEN replace(b, ',', '')::DECIMAL(30, 6) END AS y,
  CASE WHEN regexp_matches(near, '총 ?사업비') THEN 'TOTAL_PROJECT' WHEN regexp_matches(near, '회사 몫|귀속분') THEN 'COMPANY_SHARE' WHEN contains(near, '최대') THEN 'UP_TO' WHEN regexp_matches(near, '이상|초과|상회|돌파') THEN 'LOWER_BOUND'
    WHEN regexp_matches(near, '(^|[^가-힣A-Za-z0-9])약\s*[0-9가-힣]|추정|필요|(원|달러|유로|엔)\s*대') THEN 'ESTIMATE' WHEN contains(near, '~') OR contains(near, '에서') AND contains(near, '까지') THEN 'RANGE' ELSE 'EXACT' END AS basis FROM m6)
SELECT id AS order_id, s AS start, e AS end_at, fact, reported,
  CASE name WHEN 'KRW_COMPOUND' THEN x * 1000000000000 + y * 100000000 WHEN 'JO_FOREIGN' THEN x * 1000000000000 + y * 100000000 WHEN 'EOK_FOREIGN' THEN x * 100000000 + y * 10000 WHEN 'TON_COMPOUND' THEN x * 10000 + y
    WHEN 'MONEY' THEN x * CASE b WHEN '조' THEN 1000000000000 WHEN '억' THEN 100000000 WHEN '만' THEN 10000 ELSE 1 END WHEN 'CAPACITY' THEN x * CASE u WHEN 'GW' THEN 1000 ELSE 1 END ELSE x END::DOUBLE AS value,
  CASE WHEN claims = 'money' THEN CASE u WHEN '원' THEN 'KRW' WHEN '달러' THEN 'USD' WHEN '유로' THEN 'EUR' ELSE 'JPY' END WHEN name = 'PERCENT' THEN 'PERCENT' WHEN claims = 'capacity' THEN CASE u WHEN '톤' THEN 'TON' ELSE 'MW' END ELSE 'UNIT' END AS unit, basis,
  claims = 'money' AND NOT regexp_matches(text, '해지|무산|취소|철회|백지화|사실무근') AND (basis = 'EXACT' OR basis = 'COMPANY_SHARE' AND NOT regexp_matches(near, '추정|최대|이상|초과|~|(^|[^가-힣A-Za-z0-9])약\s*[0-9가-힣]') AND NOT (contains(near, '에서') AND contains(near, '까지'))) AS summable FROM m7"""


@query(_SQL)
def sentence_values(spark, d):
    """Amounts, stakes, capacities and quantities of every sentence, with their offsets."""
    # a file's row group is one task: orders are spread before their sentences are made
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice").repartition("o_orderkey")
    n = (1000 + F.floor("o_totalprice")).cast("long").cast("string")
    comma = F.concat(F.substring(n, F.lit(1), F.length(n) - 3), F.lit(","), F.right(n, F.lit(3)))
    number = F.when(F.floor(F.col("o_orderkey") / len(SENTENCES)) % 2 == 0, n).otherwise(comma)
    sentence = F.get(F.array(*map(F.lit, SENTENCES)), (F.col("o_orderkey") % len(SENTENCES)).cast("int"))
    text = F.replace(F.replace(sentence, F.lit("{k}"), (F.col("o_orderkey") % 97 + 1).cast("string")), F.lit("{n}"), number)
    v = V.value_facts(o.select(F.col("o_orderkey").alias("text_id"), text.alias("text")))
    return v.select(F.col("text_id").alias("order_id"), "start", F.col("end").alias("end_at"), "fact", "reported", F.col("value").cast("double").alias("value"), "unit", "basis", "summable")
