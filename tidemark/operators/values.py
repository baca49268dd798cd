"""Amounts in sentences: patterns in a fixed order claim spans, and the words around a span say what it is, what it stands for and whether it adds up.

A small helper finds the patterns' matches with their offsets, says what they are and lets the earlier pattern keep a span that two match: a text's
matches are together there, so nothing is shuffled and texts are read once. What a value is, stands for and adds up to are column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns in the order in which they claim, each with its claim group; words that decide kinds, bases and sums.
_NOT_IN_WORD = r"(?![가-힣A-Za-z0-9])"
PATTERNS = (
    ("KRW_COMPOUND", "money", rf"(\d+(?:\.\d+)?)\s*조\s*(\d[\d,]*)\s*억\s*(원)(대)?{_NOT_IN_WORD}"),
    ("JO_FOREIGN", "money", rf"(\d+(?:\.\d+)?)\s*조\s*,?\s*(\d[\d,]*)\s*억\s*(달러|유로|엔)(대)?{_NOT_IN_WORD}"),
    ("EOK_FOREIGN", "money", rf"(\d[\d,]*(?:\.\d+)?)\s*억\s*(\d[\d,]*(?:\.\d+)?)\s*만\s*(달러|유로|엔)(대)?{_NOT_IN_WORD}"),
    ("MONEY", "money", rf"(\d[\d,]*(?:\.\d+)?)\s*(조|억|만)?\s*(원|달러|유로|엔)(대)?{_NOT_IN_WORD}"),
    ("PERCENT", "percent", r"(\d+(?:\.\d+)?)\s*%"),
    ("TON_COMPOUND", "capacity", rf"(?<![\d,])(\d[\d,]*(?:\.\d+)?)\s*만\s*(\d[\d,]*(?:\.\d+)?)\s*(톤){_NOT_IN_WORD}"),
    ("CAPACITY", "capacity", rf"(?<![\d,])(\d[\d,]*(?:\.\d+)?)\s*()(GW|MW|톤){_NOT_IN_WORD}"),
    ("QUANTITY", "quantity", rf"(?<![\d,])(\d[\d,]*)\s*()(대|기|개){_NOT_IN_WORD}"),
)
CURRENCIES = {"원": "KRW", "달러": "USD", "유로": "EUR", "엔": "JPY"}
SCALES = {"만": 10**4, "억": 10**8, "조": 10**12}
NOT_A_DEAL = ("시총", "시가총액", "기업가치", "매출액", "영업이익", "주가")
FUNDING = ("증자", "자금조달", "투자 계획")
DEALS = (("CONTRACT_VALUE", ("계약", "수주", "공급", "납품")), ("INVESTMENT_VALUE", ("투자",)))
STAKE = ("지분", "지분율", "보유", "인수", "매각", "취득", "처분")
LOST_POWER = ("이탈", "부족")
ABSTRACT = ("공약", "과제", "그룹", "메가", "분야", "시도", "연속", "최고")
ORDINAL_TAILS = ("미만", "이상", "이하", "초반", "중반", "후반", "신도시")
RANKED = ("세계", "국내", "글로벌", "아시아")
SUM_BLOCKED = ("해지", "무산", "취소", "철회", "백지화", "사실무근")
APPROXIMATE = r"(?<![가-힣A-Za-z0-9])약\s*(?=[0-9가-힣])"
_AROUND, _NUMBER = 44, "decimal(38,6)"
# signs without which a pattern finds nothing
_SIGNS = {"KRW_COMPOUND": "조억원", "JO_FOREIGN": "조억", "EOK_FOREIGN": "억만", "PERCENT": "%", "TON_COMPOUND": "만톤"}
_COMPILED = tuple((k, name, group, _SIGNS.get(name, ""), re.compile(p)) for k, (name, group, p) in enumerate(PATTERNS))
_any = lambda *words: re.compile("|".join(words)).search
_not_a_deal, _funding, _stake, _lost_power, _ranked = _any(*NOT_A_DEAL), _any(*FUNDING), _any(*STAKE), _any(*LOST_POWER), _any(*RANKED)
_abstract = re.compile(rf"[ \t\n\x0b\f\r]*(?:{'|'.join((*ABSTRACT, *ORDINAL_TAILS))})").match
_parenthetical, _digit = re.compile(r"\([^)]*\)"), re.compile(r"\d").search


def _deal(left: str, right: str) -> str | None:
    """CONTRACT_VALUE or INVESTMENT_VALUE by the marker nearest to the amount, parenthetical parts left out; none for what is no deal."""
    before, after = (_parenthetical.sub("", c) if "(" in c else c for c in (left, right))
    if _not_a_deal(before[-16:]) or _funding(before[-12:] + after[:16]):
        return None
    window, pivot = (before[-28:] + "|" + after[:36]).replace("공급망", ""), len(before[-28:])
    found = []
    for fact, markers in DEALS:
        for marker in markers:
            # the last one that starts before the amount, the first one that doesn't
            if (i := window.rfind(marker, 0, pivot - 1 + len(marker))) >= 0:
                found.append((pivot - i - len(marker), fact))
            if (i := window.find(marker, pivot)) >= 0:
                found.append((i - pivot, fact))
    away, fact = min(found, default=(99, None))
    return fact if away <= 18 else None


def _fact(name: str, group: str, reported: str, unit: str, left: str, right: str) -> str | None:
    if group == "money":
        return _deal(left, right)
    if name == "PERCENT":
        return "STAKE_PERCENT" if left[-2:] not in ("(+", "(-") and _stake(left[-16:] + reported + right[:12]) else None
    if group == "capacity":
        return "CAPACITY" if name == "TON_COMPOUND" or not _lost_power(left[-12:] + reported + right[:12]) else None
    return "QUANTITY" if not _abstract(right[:12]) and left[-1:] != "제" and not (unit == "대" and _ranked(left[-4:])) else None


def _facts_of(text: str) -> list[tuple]:
    """Pattern, claim group, start, end, fact, matched text, its parts, and what is around it, of every match that is a fact and keeps its span."""
    out: list[tuple] = []
    if not _digit(text):
        return out
    for k, name, group, signs, pattern in _COMPILED:
        if signs and not all(sign in text for sign in signs):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            left, right = text[max(0, a - _AROUND) : a], text[b : b + _AROUND]
            first, second, unit = (*m.groups(""), "", "")[:3]
            if fact := _fact(name, group, m[0], unit, left, right):
                out.append((k, name, group, a, b, fact, m[0], first, second, unit, left[-16:], right[:12]))
    if len(out) < 2:
        return out
    # the earlier pattern of a claim group keeps a span that both match; a later one is kept out even by one that lost its own
    spans: dict[str, list] = {}
    for x in out:
        if x[2] in ("money", "capacity"):
            spans.setdefault(x[2], []).append((x[3], x[4], x[0]))
    ordered = {group: _Spans(found) for group, found in spans.items()}
    return [x for x in out if x[2] not in ordered or not ordered[x[2]].taken(x[3], x[4], x[0])]


class _Spans:
    """Spans of a claim group by pattern. Those of one pattern don't overlap, so that of all that start before an end the last one alone can reach a start."""

    def __init__(self, found: list[tuple[int, int, int]]):
        self.by: dict[int, tuple[list[int], list[int]]] = {}
        for a, b, k in found:
            starts, ends = self.by.setdefault(k, ([], []))
            starts.append(a)
            ends.append(b)

    def taken(self, a: int, b: int, k: int) -> bool:
        return any(other < k and (i := bisect_left(starts, b)) and ends[i - 1] > a for other, (starts, ends) in self.by.items())


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 7)
    for batch in batches:
        row, out = [], []
        for i, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
            if text and (found := _facts_of(text)):
                row += [i] * len(found)
                out += found
        rest = batch.drop_columns(["text"]).take(pa.array(row, pa.int64()))
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)]
        yield pa.RecordBatch.from_arrays([*rest.columns, *cols], names=[*rest.schema.names, "pattern", "name", "claims", "start", "end", "fact", "reported", "first", "second", "unit", "left", "right"])


def _has(text: Column, *words: str) -> Column:
    return F.rlike(text, F.lit("|".join(words)))


def basis(window: Column) -> Column:
    """What a value stands for, by the words around it, in order of precedence."""
    estimate = F.rlike(window, F.lit(APPROXIMATE)) | _has(window, "추정", "필요", r"(?:원|달러|유로|엔)\s*대")
    between = F.contains(window, F.lit("~")) | (F.contains(window, F.lit("에서")) & F.contains(window, F.lit("까지")))
    return (
        F.when(_has(window, "총사업비", "총 사업비"), "TOTAL_PROJECT").when(_has(window, "회사 몫", "귀속분"), "COMPANY_SHARE").when(_has(window, "최대"), "UP_TO")
        .when(_has(window, "이상", "초과", "상회", "돌파"), "LOWER_BOUND").when(estimate, "ESTIMATE").when(between, "RANGE").otherwise("EXACT")
    )


def _decimal(c: str) -> Column:
    return F.replace(F.col(c), F.lit(","), F.lit("")).try_cast(_NUMBER)


def value_facts(texts: DataFrame) -> DataFrame:
    """texts: text_id, text. Adds a row a fact: text_id, start and end (code points, end exclusive), fact, reported, value (decimal), unit, currency, basis, summable.

    Texts of any length are read whole; null and empty ones give no rows; a value that no decimal(38,6) holds is null."""
    blocked = _has(F.col("text"), *SUM_BLOCKED)
    kind = dict(texts.dtypes)["text_id"]
    schema = f"text_id {kind}, blocked boolean, pattern int, name string, claims string, start int, end int, fact string, reported string, first string, second string, unit string, left string, right string"
    m = texts.select("text_id", blocked.alias("blocked"), "text").mapInArrow(_find, schema)
    name, near = F.col("name"), F.concat("left", "reported", "right")
    first, second = _decimal("first"), F.coalesce(_decimal("second"), F.lit(0).cast(_NUMBER))
    times = lambda c, n: (c * F.lit(n).cast("decimal(14,0)")).cast(_NUMBER)
    scaled = F.when(F.col("second") == "조", times(first, SCALES["조"])).when(F.col("second") == "억", times(first, SCALES["억"])).when(F.col("second") == "만", times(first, SCALES["만"])).otherwise(first)
    value = (
        F.when(name.isin("KRW_COMPOUND", "JO_FOREIGN"), (times(first, SCALES["조"]) + times(second, SCALES["억"])).cast(_NUMBER))
        .when(name == "EOK_FOREIGN", (times(first, SCALES["억"]) + times(second, SCALES["만"])).cast(_NUMBER))
        .when(name == "MONEY", scaled)
        .when(name == "TON_COMPOUND", (times(first, SCALES["만"]) + second).cast(_NUMBER))
        .when(F.col("unit") == "GW", times(first, 1000))
        .otherwise(first)
    )
    currency = F
    for sign, code in CURRENCIES.items():
        currency = currency.when((F.col("claims") == "money") & (F.col("unit") == sign), code)
    unit = F.when(F.col("claims") == "money", currency).when(name == "PERCENT", "PERCENT").when(F.col("claims") == "capacity", F.when(F.col("unit") == "톤", "TON").otherwise("MW")).otherwise("UNIT")
    stands = basis(near)
    share = (stands == "COMPANY_SHARE") & ~F.rlike(near, F.lit(APPROXIMATE)) & ~_has(near, "추정", "최대", "이상", "초과", "~") & ~(F.contains(near, F.lit("에서")) & F.contains(near, F.lit("까지")))
    summable = (F.col("claims") == "money") & ~F.col("blocked") & ((stands == "EXACT") | share)
    return m.select("text_id", "start", "end", "fact", "reported", value.alias("value"), unit.alias("unit"), currency.alias("currency"), stands.alias("basis"), summable.alias("summable"))
