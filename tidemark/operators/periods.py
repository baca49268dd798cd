"""Days, periods and amounts that texts ask for, as intervals and bounds over a table of texts.

Expressions claim spans in a fixed order, so that "2024년 3월" isn't a year as well. A small helper finds matches with their offsets; what they
mean, and which of them keep their spans, are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in the order in which they claim spans. A pattern counts wherever it matches, a marker at its first place alone.
DAYS = (
    ("YMD", r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"),
    ("YMD", r"(?<![0-9])(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?![0-9])"),
    ("LAST_MONDAY", "지난 월요일"), ("LAST_TUESDAY", "지난 화요일"), ("LAST_WEDNESDAY", "지난 수요일"), ("LAST_THURSDAY", "지난 목요일"), ("LAST_FRIDAY", "지난 금요일"),
    ("PREVIOUS_TRADING_DAY", "전 거래일"), ("PREVIOUS_TRADING_DAY", "직전 거래일"), ("PREVIOUS_TRADING_DAY", "지난 거래일"),
    ("DAY_BEFORE_YESTERDAY", "그저께"), ("DAY_BEFORE_YESTERDAY", "그제"), ("DAY_BEFORE_YESTERDAY", "그저깨"),
    ("YESTERDAY", "어제"), ("YESTERDAY", "어저께"), ("YESTERDAY", "전일"),
    ("TODAY", "오늘"), ("TODAY", "금일"), ("TODAY", "지금"), ("TODAY", "현재"),
    ("MD", r"(?<![0-9])(\d{1,2})\s*월\s*(\d{1,2})\s*일"),
    ("MD", r"(?<![0-9./-])(\d{1,2})[/.](\d{1,2})(?![0-9./-])"),
)
PERIODS = (
    ("YM", r"(\d{4})\s*년\s*(\d{1,2})\s*월"),
    ("RECENT_DAYS", r"최근\s*(\d{1,3})\s*일"), ("RECENT_WEEKS", r"최근\s*(\d{1,2})\s*주"), ("RECENT_MONTHS", r"최근\s*(\d{1,2})\s*(?:개월|달)"), ("RECENT_YEARS", r"최근\s*(\d{1,2})\s*년"),
    ("LAST_7_DAYS", "최근 일주일"), ("LAST_MONTH", "최근 한 달"), ("LAST_MONTH", "최근 한달"), ("THIS_WEEK", "이번 주"), ("THIS_WEEK", "이번주"), ("THIS_WEEK", "금주"),
    ("LAST_WEEK", "지난 주"), ("LAST_WEEK", "지난주"), ("LAST_WEEK", "저번 주"), ("THIS_MONTH", "이번 달"), ("THIS_MONTH", "이번달"), ("THIS_MONTH", "이달"), ("LAST_MONTH", "지난 달"), ("LAST_MONTH", "지난달"),
    ("THIS_YEAR", "올해"), ("THIS_YEAR", "금년"), ("LAST_YEAR", "작년"), ("LAST_YEAR", "지난해"), ("RECENT", "최근"),
    ("ALL_TIME", "과거"), ("ALL_TIME", "역대"), ("ALL_TIME", "지금까지"), ("ALL_TIME", "여태"), ("ALL_TIME", "이제까지"),
    ("Y", r"(?<![0-9])(\d{4})\s*년"), ("Y", r"(?<![0-9])(19[5-9]\d|20\d{2})(?![0-9])"),
)
COLLECTED_FROM, RECENT_DAYS = "2007-01-01", 90
AMOUNT = r"(\d+(?:[.,]\d+)?)\s*(조원|조|억원|억|천만원|백만원|만원|원)\s*(이상|초과|넘는|넘은|넘게|이하|미만)?"
UNITS = {"조원": 10**12, "조": 10**12, "억원": 10**8, "억": 10**8, "만원": 10**4, "천만원": 10**7, "백만원": 10**6, "원": 1}
COMPARATORS = {"이상": "GTE", "초과": "GT", "넘는": "GT", "넘은": "GT", "넘게": "GT", "이하": "LTE", "미만": "LT"}

_ALL = (*(("DATE", k, p) for k, p in DAYS), *(("PERIOD", k, p) for k, p in PERIODS))
_WEEKDAYS = ("LAST_MONDAY", "LAST_TUESDAY", "LAST_WEDNESDAY", "LAST_THURSDAY", "LAST_FRIDAY")
_COMPILED = tuple((kind, name, re.compile(p), "\\" not in p) for kind, name, p in _ALL)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, out = [], []
        for i, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
            for k, (kind, name, pattern, once) in enumerate(_COMPILED):
                for m in pattern.finditer(text or ""):
                    row.append(i)
                    out.append((k, kind, name, *m.span(), m[0], [int(g) for g in m.groups()]))
                    if once:
                        break
        rest = batch.drop_columns(["text"]).take(pa.array(row, pa.int64()))
        types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array([r[j] for r in out], t) for j, t in enumerate(types))], names=[*rest.schema.names, "place", "kind", "name", "start", "end", "literal", "n"])


def _date(y: Column, m: Column, d: Column) -> Column:
    """null where there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def _bounds() -> tuple[Column, Column, Column]:
    """First and last day, and the name, of what an expression means on the text's day; null days where it means nothing."""
    name, today = F.col("name"), F.col("today")
    n = lambda i: F.get("n", F.lit(i))
    one = lambda days: F.date_sub(today, days)
    year = F.year(today)
    day = F.when(name == "YMD", _date(n(0), n(1), n(2))).when(name == "PREVIOUS_TRADING_DAY", one(1)).when(name == "DAY_BEFORE_YESTERDAY", one(2)).when(name == "YESTERDAY", one(1)).when(name == "TODAY", today)
    for i, w in enumerate(_WEEKDAYS):
        back = F.pmod(F.weekday(today) - i, F.lit(7))
        day = day.when(name == w, F.date_sub(today, F.when(back == 0, 7).otherwise(back)))
    this = _date(year, n(0), n(1))
    day = day.when(name == "MD", F.when(this > today, F.coalesce(_date(year - 1, n(0), n(1)), this)).otherwise(this))
    monday, first = F.date_sub(today, F.weekday(today)), F.trunc(today, "month")
    starts, ends = F, F
    some = n(0) > 0
    ym = _date(n(0), n(1), F.lit(1))
    back = lambda months: F.date_add(F.add_months(today, -months), 1)
    for what, a, b in (
        ("YM", ym, F.last_day(ym)), ("RECENT_DAYS", F.date_sub(today, n(0) - 1), today), ("RECENT_WEEKS", F.date_sub(today, n(0) * 7 - 1), today), ("RECENT_MONTHS", back(n(0)), today), ("RECENT_YEARS", back(n(0) * 12), today),
        ("LAST_7_DAYS", one(6), today), ("THIS_WEEK", monday, today), ("LAST_WEEK", F.date_sub(monday, 7), F.date_sub(monday, 1)), ("THIS_MONTH", first, today), ("LAST_MONTH", F.add_months(first, -1), F.date_sub(first, 1)),
        ("THIS_YEAR", F.trunc(today, "year"), today), ("LAST_YEAR", F.add_months(F.trunc(today, "year"), -12), F.date_sub(F.trunc(today, "year"), 1)), ("RECENT", one(RECENT_DAYS - 1), today), ("ALL_TIME", F.lit(COLLECTED_FROM).cast("date"), today),
        ("Y", _date(n(0), F.lit(1), F.lit(1)), _date(n(0), F.lit(12), F.lit(31))),
    ):
        holds = (name == what) & some if what.startswith("RECENT_") else name == what
        starts, ends = starts.when(holds, a), ends.when(holds, b)
    special = (
        F.when(name == "RECENT_DAYS", F.when(n(0) == 7, "LAST_7_DAYS").otherwise("RECENT")).when(name == "RECENT_WEEKS", F.when(n(0) == 1, "LAST_7_DAYS").otherwise("RECENT"))
        .when(name == "RECENT_MONTHS", F.when(n(0) == 1, "LAST_MONTH").when(n(0) == 3, "LAST_3_MONTHS").when(n(0) == 12, "LAST_12_MONTHS").otherwise("RECENT"))
        .when(name == "RECENT_YEARS", F.when(n(0) == 1, "LAST_12_MONTHS").otherwise("RECENT")).when(name.isin("YMD", "MD", "YM", "Y"), None).otherwise(name)
    )
    is_day = F.col("kind") == "DATE"
    return F.when(is_day, day).otherwise(starts), F.when(is_day, day).otherwise(ends), special


def _claimed(found: Column) -> Column:
    """Of found (place, start, end, ...) those that overlap none taken before, in order of place, then start."""
    ordered = F.array_sort(found)  # by its first fields
    overlaps = lambda acc, x: F.exists(acc, lambda t: (t["start"] < x["end"]) & (x["start"] < t["end"]))
    return F.aggregate(ordered, F.filter(ordered, lambda x: F.lit(False)), lambda acc, x: F.when(overlaps(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def intervals(texts: DataFrame) -> DataFrame:
    """texts: text_id (unique), text, today. A row an expression: text_id, start and end (code points, end exclusive), kind (DATE or PERIOD), literal, expression (null for
    absolute ones), from_day, to_day. A day and month without a year is the latest such day not after today. Null and empty texts give no rows."""
    kind = dict(texts.dtypes)["text_id"]
    m = texts.select("text_id", F.col("today").cast("date").alias("today"), "text").mapInArrow(_find, f"text_id {kind}, today date, place int, kind string, name string, start int, end int, literal string, n array<int>")
    a, b, name = _bounds()
    m = m.withColumn("from_day", a).withColumn("to_day", b).withColumn("expression", name).where("from_day is not null and to_day is not null")
    g = m.groupBy("text_id").agg(F.collect_list(F.struct("place", "start", "end", "kind", "literal", "expression", "from_day", "to_day")).alias("found"))
    x = g.select("text_id", F.explode(_claimed(F.col("found"))).alias("x"))
    return x.select("text_id", "x.start", "x.end", "x.kind", "x.literal", "x.expression", "x.from_day", "x.to_day")


def asked_range(found: DataFrame) -> DataFrame:
    """found: of intervals(). Per text the range asked for: from the first to the last of two days or more, else the one day, else the first period."""
    g = found.groupBy("text_id").agg(F.count_if(F.col("kind") == "DATE").alias("days"), F.min(F.when(F.col("kind") == "DATE", F.col("from_day"))).alias("a"), F.max(F.when(F.col("kind") == "DATE", F.col("to_day"))).alias("b"), F.min(F.when(F.col("kind") == "PERIOD", F.struct("start", "from_day", "to_day"))).alias("p"))
    return g.select("text_id", F.when(F.col("days") > 0, F.col("a")).otherwise(F.col("p.from_day")).alias("from_day"), F.when(F.col("days") > 0, F.col("b")).otherwise(F.col("p.to_day")).alias("to_day"), F.when(F.col("days") > 1, "DATES").when(F.col("days") == 1, "DATE").otherwise("PERIOD").alias("asked"))


def amount(text: Column) -> Column:
    """The first amount with its comparator (GTE where none is said), value (decimal) and literal; null without any."""
    part = lambda i: F.regexp_extract(text, AMOUNT, i)
    times, sign = F, F
    for unit, n in UNITS.items():
        times = times.when(part(2) == unit, F.lit(n).cast("decimal(14,0)"))
    for marker, name in COMPARATORS.items():
        sign = sign.when(part(3) == marker, name)
    value = (F.replace(part(1), F.lit(","), F.lit("")).try_cast("decimal(22,6)") * times).cast("decimal(38,6)")
    return F.when(part(0) != "", F.struct(sign.otherwise("GTE").alias("comparator"), value.alias("value"), F.trim(part(0)).alias("literal")))
