"""Days, periods and amounts in texts, by hand."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.operators import periods

TODAY = date(2024, 3, 6)  # a Wednesday
CASES = [
    ("2024년 2월 30일과 2024-02-29", [("2024년 2월", None, date(2024, 2, 1), date(2024, 2, 29)), ("2024-02-29", None, date(2024, 2, 29), date(2024, 2, 29))]),
    ("지난 수요일", [("지난 수요일", "LAST_WEDNESDAY", date(2024, 2, 28), date(2024, 2, 28))]),
    ("지난 월요일", [("지난 월요일", "LAST_MONDAY", date(2024, 3, 4), date(2024, 3, 4))]),
    ("3월 7일, 3/6", [("3월 7일", None, date(2023, 3, 7), date(2023, 3, 7)), ("3/6", None, TODAY, TODAY)]),
    ("최근 0일", [("최근", "RECENT", date(2023, 12, 8), TODAY)]),
    ("최근 7일", [("최근 7일", "LAST_7_DAYS", date(2024, 2, 29), TODAY)]),
    ("최근 3개월", [("최근 3개월", "LAST_3_MONTHS", date(2023, 12, 7), TODAY)]),
    ("최근 1년", [("최근 1년", "LAST_12_MONTHS", date(2023, 3, 7), TODAY)]),
    ("지난달 올해", [("지난달", "LAST_MONTH", date(2024, 2, 1), date(2024, 2, 29)), ("올해", "THIS_YEAR", date(2024, 1, 1), TODAY)]),
    ("2023년 3월 2022 12345", [("2023년 3월", None, date(2023, 3, 1), date(2023, 3, 31)), ("2022", None, date(2022, 1, 1), date(2022, 12, 31))]),
    ("역대", [("역대", "ALL_TIME", date(2007, 1, 1), TODAY)]),
    ("", []),
    (None, []),
]


def test_intervals(spark):
    texts = spark.createDataFrame([(i, t, TODAY) for i, (t, _) in enumerate(CASES)], "text_id long, text string, today date").repartition(3)
    got: dict = {}
    found = periods.intervals(texts)
    for r in sorted(found.collect(), key=lambda r: (r["text_id"], r["start"])):
        assert CASES[r["text_id"]][0][r["start"] : r["end"]] == r["literal"]
        got.setdefault(r["text_id"], []).append((r["literal"], r["expression"], r["from_day"], r["to_day"]))
    assert got == {i: w for i, (_, w) in enumerate(CASES) if w}
    asked = {r["text_id"]: tuple(r)[1:] for r in periods.asked_range(found).collect()}
    assert asked[3] == (date(2023, 3, 7), TODAY, "DATES") and asked[0] == (date(2024, 2, 29), date(2024, 2, 29), "DATE") and asked[8] == (date(2024, 2, 1), date(2024, 2, 29), "PERIOD")
    assert periods.intervals(texts.limit(0)).count() == 0


def test_amounts(spark):
    cases = [("수주액 1.5조원 이상", ("GTE", 1_500_000_000_000)), ("300억 넘는 계약", ("GT", 30_000_000_000)), ("2천만원 이하 3원 미만", ("LTE", 20_000_000)), ("5만원", ("GTE", 50_000)), ("없음", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string").select("i", periods.amount(F.col("text")).alias("m"))
    assert {r["i"]: r["m"] and (r["m"]["comparator"], r["m"]["value"]) for r in df.collect()} == {i: w and (w[0], Decimal(w[1])) for i, (_, w) in enumerate(cases)}


def test_article_urls(spark):
    from tidemark.functions import text

    cases = {
        " http://WWW.Example.com:80/a/b//?b=2&a=x%20y&UTM_Source=q&ref=1#top": "https://example.com/a/b?a=x+y&b=2",
        "HTTPS://u:p@m.example.com:8443": "https://m.example.com:8443/",
        "https://x.y/?q=&k&&q=1": "https://x.y/?k=&q=&q=1",
        "https://x.y/p?t=a*b~%C3%A9+z": "https://x.y/p?t=a%2Ab~%C3%A9+z",
        "ftp://x.y/": None,
        "/relative": None,
        "": None,
    }
    df = spark.createDataFrame([(u,) for u in cases] + [(None,)], "u string").select("u", text.article_url(F.col("u")).alias("v"))
    assert {r["u"]: r["v"] for r in df.collect()} == cases | {None: None}
