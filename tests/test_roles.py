"""Dictionary names and company roles on golden sentences; the queries' SQL has the same rules by joins."""

from datetime import date

import pytest

from tidemark.operators import dictionary, roles

ALIASES = [
    ("알파", "001", None, None, True), ("알파전자", "002", None, None, True), ("베타", "003", None, None, True), ("감마 중공업", "004", date(2000, 1, 1), date(2010, 1, 1), True), ("델타", "005", None, None, True),
    ("델타", "006", None, None, True), ("엡실론", "007", None, None, False), ("대상", "008", None, None, True), ("(주)제타", "009", None, None, True), ("...", "010", None, None, True),
]
SENTENCES = [
    ("알파가 베타와 공급계약 체결", [("알파", "RESOLVED", ["ACTOR", "CONTRACTOR"]), ("베타", "RESOLVED", ["COUNTERPARTY"])]),
    ("알파, 베타 인수 추진", [("알파", "RESOLVED", ["ACTOR"]), ("베타", "RESOLVED", ["TARGET"])]),
    ("알파 유상증자 결정 및 규제 강화에 따른 베타 수혜", [("알파", "RESOLVED", ["ACTOR", "ISSUER"]), ("베타", "RESOLVED", ["BENEFICIARY"])]),
    ("알파전자 압수수색 소식", [("알파전자", "RESOLVED", ["TARGET"])]),
    ("알파전자나 발표", []),  # neither the long name nor the short one ends at a boundary
    ("최선호주로 알파 선정", [("알파", "RESOLVED", ["TARGET"])]),
    ("감마 중공업 수주", [("감마 중공업", "OUT_OF_VALIDITY", [])]),
    ("델타 발표 엡실론 공시", [("델타", "AMBIGUOUS_ALIAS", []), ("엡실론", "UNKNOWN_STOCK_CODE", [])]),
    ("혜택 대상 포함, 대상이 발표", [("대상", "RESOLVED", ["ACTOR"])]),
    ("알파 투자심리 위축 베타 타격", [("알파", "RESOLVED", []), ("베타", "RESOLVED", ["ADVERSELY_AFFECTED"])]),
    ("베타 감산 수혜. 알파 투자", [("베타", "RESOLVED", ["BENEFICIARY"]), ("알파", "RESOLVED", ["ACTOR"])]),
    ("알파 회장 발표", []),
    ("(주)제타 유상증자", [("(주)제타", "RESOLVED", ["ISSUER"])]),
    ("알파와 베타, 공동 개발 합의", [("알파", "RESOLVED", []), ("베타", "RESOLVED", ["ACTOR"])]),
    ("알파 잠정 실적 전망 상회", [("알파", "RESOLVED", [])]),
    ("알파 실적 발표", [("알파", "RESOLVED", ["ISSUER"])]),  # 발표 within the issuer's evidence is no action of its own
    ("x알파 발표", []),
    ("알파 투자에 따른 베타 수혜", [("알파", "RESOLVED", ["ACTOR"]), ("베타", "RESOLVED", ["BENEFICIARY"])]),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("most", [dictionary.BROADCAST_NAMES, 0])
def test_roles_of_sentences(spark, monkeypatch, most):
    monkeypatch.setattr(dictionary, "BROADCAST_NAMES", most)
    aliases = spark.createDataFrame(ALIASES, "alias string, code string, valid_from date, valid_to date, known boolean")
    texts = spark.createDataFrame([(i, t, date(2024, 1, 1)) for i, (t, _) in enumerate(SENTENCES)], "text_id long, text string, as_of date")
    got = {}
    for r in sorted(roles.body_roles(texts, aliases).collect()):
        text = SENTENCES[r["text_id"]][0]
        assert text[r["start"] : r["end"]] == r["mention_text"] and all(x["start"] == r["start"] and x["end"] > r["end"] for x in r["roles"])
        got.setdefault(r["text_id"], []).append((r["mention_text"], r["status"], [x["role"] for x in r["roles"]]))
    assert {i: got.get(i, []) for i in range(len(SENTENCES))} == {i: w for i, (_, w) in enumerate(SENTENCES)}
    assert roles.body_roles(texts.limit(0), aliases).count() == 0 and roles.body_roles(texts, aliases.limit(0)).count() == 0


def test_names_are_joined_not_scanned(spark):
    """The plan has an equality join on words, no pattern of names and no nested loop."""
    aliases = spark.createDataFrame(ALIASES, "alias string, code string, valid_from date, valid_to date, known boolean")
    texts = spark.createDataFrame([(1, "알파 발표", date(2024, 1, 1))], "text_id long, text string, as_of date")
    plan = dictionary.mentions(texts, aliases)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "알파전자" not in plan
