"""Amounts in sentences, by hand."""

from decimal import Decimal

from tidemark.operators import values

CASES = [
    ("1조 2,000억원 규모 공급계약 체결", [("CONTRACT_VALUE", "1조 2,000억원", "1200000000000", "KRW", "EXACT", True)]),
    ("1조,2000억 달러 투자", [("INVESTMENT_VALUE", "1조,2000억 달러", "1200000000000", "USD", "EXACT", True)]),
    ("3억 5,000만 달러 수주", [("CONTRACT_VALUE", "3억 5,000만 달러", "350000000", "USD", "EXACT", True)]),
    ("약 300억원 투자 결정", [("INVESTMENT_VALUE", "300억원", "30000000000", "KRW", "ESTIMATE", False)]),
    ("2,760억원(최근 매출액대비 25.67%) 규모 선박 수주", [("CONTRACT_VALUE", "2,760억원", "276000000000", "KRW", "EXACT", True)]),
    ("매출액 500억원 공급", []),
    ("유상증자 500억원 투자", []),
    ("지분 12.5% 취득", [("STAKE_PERCENT", "12.5%", "12.5", "PERCENT", "EXACT", False)]),
    ("지분(+3.1%) 강세", []),
    ("주가 3.1% 상승", []),
    ("1.5GW 설비와 3만 2000톤 생산", [("CAPACITY", "1.5GW", "1500", "MW", "EXACT", False), ("CAPACITY", "3만 2000톤", "32000", "TON", "EXACT", False)]),
    ("전력 2GW 부족", []),
    ("전기차 300대 공급", [("QUANTITY", "300대", "300", "UNIT", "EXACT", False)]),
    ("세계 7대 시장, 제21대 총선, 50대 미만, 9개 분야, 국내 9개 게임사", [("QUANTITY", "9개", "9", "UNIT", "EXACT", False)]),
    ("100억원 계약 해지", [("CONTRACT_VALUE", "100억원", "10000000000", "KRW", "EXACT", False)]),
    ("100억원 계약, 총사업비 100억원 계약", [("CONTRACT_VALUE", "100억원", "10000000000", "KRW", "TOTAL_PROJECT", False), ("CONTRACT_VALUE", "100억원", "10000000000", "KRW", "TOTAL_PROJECT", False)]),
    ("회사 몫 70억원 계약", [("CONTRACT_VALUE", "70억원", "7000000000", "KRW", "COMPANY_SHARE", True)]),
    ("100억원대학 계약", []),
    ("", []),
    (None, []),
]


def test_values_of_sentences(spark):
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "text_id long, text string").repartition(3)
    got: dict = {}
    for r in sorted(values.value_facts(texts).collect(), key=lambda r: (r["text_id"], r["start"])):
        assert CASES[r["text_id"]][0][r["start"] : r["end"]] == r["reported"]
        got.setdefault(r["text_id"], []).append((r["fact"], r["reported"], r["value"], r["unit"], r["basis"], r["summable"]))
    want = {i: [(f, t, Decimal(v), u, b, s) for f, t, v, u, b, s in facts] for i, (_, facts) in enumerate(CASES) if facts}
    assert got == want
    assert values.value_facts(texts.limit(0)).count() == 0


def test_texts_are_read_once_and_nothing_is_shuffled(spark):
    """What keeps a span is settled where a text's matches are together, not by joining them with themselves."""
    texts = spark.createDataFrame([(1, "1조 2,000억원 공급, 3만 2000톤 생산"), (1, "2,000억원 공급")], "text_id long, text string")
    facts = values.value_facts(texts)
    plan = facts._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.count("mapinarrow") == 1 and "exchange" not in plan and "join" not in plan
    assert sorted(r["reported"] for r in facts.collect()) == ["1조 2,000억원", "2,000억원", "3만 2000톤"]
    many = values._facts_of("5조 3억원 공급 " * 400)
    assert len(many) == 400 and {x[1] for x in many} == {"KRW_COMPOUND"}
