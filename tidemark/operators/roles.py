"""Roles of companies in a sentence: markers near a name, rules of subject and object, and other companies between."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dictionary

# Markers of each role. Where several begin at one place the longest counts.
CONTRACT = ("공급계약 체결", "납품계약 체결", "수주계약 체결", "양해각서(MOU) 체결", "양해각서 체결", "업무협약 체결", "MOU 체결", "계약을 체결", "계약 체결", "공급 계약", "공급계약", "납품 계약", "납품계약", "수주 계약", "수주계약", "수주")
COLLABORATION = ("공동 개발", "공동개발", "합작법인 설립", "사업 협력", "전략적 협력", "업무협약", "양해각서", "협력", "제휴")
ISSUER = ("신주인수권부사채", "전환사채", "유상증자", "무상증자", "주식분할", "액면분할", "상장폐지", "실적 발표", "잠정 실적", "영업이익", "흑자전환", "적자전환", "매출액", "자사주", "회사채 발행", "배당", "감자", "IPO", "상장", "호실적")
ACTION = (
    *CONTRACT, "합작법인 설립", "공동 개발", "공동개발", "투자 결정", "투자 발표", "개발 성공", "임상 성공", "승인 신청", "허가 신청", "인수 추진", "합병 결정", "분할 결정", "매각 결정", "생산 개시", "공급 개시", "서비스 출시", "제품 출시", "사업 진출", "업무협약", "양해각서",
    "발표", "공개", "개발", "투자", "설립", "출시", "생산", "공급", "체결", "인수", "합병", "분할", "매각", "취득", "처분", "신청", "제출", "진출", "착공", "준공", "공시", "추진", "결정", "선정", "참여", "협력", "제휴", "성공", "완료", "중단", "취소", "합의",
)
PASSIVE = ("인수 대상", "매각 대상", "제재 대상", "규제 대상", "소송 대상", "상장폐지", "거래정지", "압수수색", "피인수", "피소")
REGULATORY = ("제재", "규제", "일시정지", "실사")
ACQUISITION = ("인수", "매각", "편입")
SELECTION = ("선정", "지정", "포함", "결정")
BENEFIT = ("반사 수혜", "반사수혜", "수혜")
ADVERSE = ("피해 우려", "피해", "비용 부담", "부담", "악영향", "타격", "손실")
# How far after a name a marker may end, ranks of roles, patterns of particles, sentence ends.
WITHIN = {"contract": 112, "collaboration": 96, "passive": 48, "regulatory": 48, "acquisition": 32, "selection": 48, "benefit": 48, "adverse": 48, "issuer": 80, "action": 96}
ROLES = ("ACTOR", "ISSUER", "CONTRACTOR", "COUNTERPARTY", "TARGET", "BENEFICIARY", "ADVERSELY_AFFECTED", "LEADER", "RELATED")
NEAR = 12
COUNTERPARTY = r"^\s*(?:(?:측\s*)?(?:와|과)(?:의)?|로부터|상대로|에게|에)"
JOINT = r"^\s*(?:측\s*)?(?:와|과)(?:의)?\s*[가-힣A-Za-z0-9·]+\s*,"
PREFIX = r"^\s*(?:(?:측)?(?:은|는|이|가|도))?\s*[,：:]"
DIRECT = r"^\s*(?:(?:측)?(?:은|는|이|가|도))\s*"
TRAILING_RO = r"[가-힣]로\s*$"
SENTENCE_END = r"[.!?;。\n]"
TITLE = r"^\s*(?:美|미국|인도|중국|유럽)?\s*(?:부회장|회장|사장|대표이사|의장|자회사|(?:판매)?법인(?!세))"
#: Spellings of markers that mark nothing: what follows or goes before them speaks of something else. Each is blanked, length kept;
#: those of issuers in a text of their own, for other roles read parts of them.
_FORECAST = "(?=.{0,8}(?:전망|기대|우려|영향|하회)|.{0,6}컨센서스)"
MISLEADING = ((r"투자(?=심리)", 2), (r"(?<=(?:고객|2차).{0,8}|(?:이용자|소비자|가입자).{0,7}|소액결제.{0,6})피해", 2))
MISLEADING_ISSUER = ((f"호(?=실적{_FORECAST})", 1), (f"(?<=실적 )발(?=표{_FORECAST})", 1), (f"잠(?=정 실적{_FORECAST})", 1), (f"영(?=업이익{_FORECAST})", 1), (f"매(?=출액{_FORECAST})", 1), (r"상(?=장\s{0,2}흥행)", 1))
_BLANK, _REACH = "¤", 132


def _any(markers: tuple) -> str:
    return "|".join(m.replace("(", r"\(").replace(")", r"\)") for m in sorted(set(markers), key=lambda m: (-len(m), m)))


def _generic(text: Column, s: Column) -> Column:
    """The name is a word of its own here, or names a person or another firm of the company."""
    after = F.substring(text, s["end"] + 1, F.lit(10))
    common = (s["name"] == "대상") & ~F.rlike(F.substring(after, 1, 1), F.lit("[,은는이가의]"))
    region = F.rlike(F.substring(after, 1, 8), F.lit("^도|구제역|ASF|지역|도내"))
    return F.when(s["name"] == "대상", common).when(s["name"] == "강원", region).otherwise(F.rlike(after, F.lit(TITLE)))


def _contexts(found: DataFrame) -> DataFrame:
    """One row a mention with what its rules read: the text around it, names after it, whether a subject goes before it. All of bounded size."""
    text = F.col("text")
    blanked = lambda misleading: reduce(lambda t, m: F.regexp_replace(t, "(?s)" + m[0], _BLANK * m[1]), misleading, text)
    x = found.withColumn("spans", F.filter("spans", lambda s: ~_generic(text, s))).withColumn("masked", blanked(MISLEADING)).withColumn("issuers", blanked(MISLEADING_ISSUER))

    def context(s: Column, i: Column) -> Column:
        near = F.filter("spans", lambda o: (o["start"] >= s["end"]) & (o["start"] < s["end"] + _REACH))
        subject = lambda o: F.rlike(F.substring(text, o["end"] + 1, F.least(s["start"] - o["end"], F.lit(16))), F.lit(f"{PREFIX}|{DIRECT}"))
        return F.struct(
            i.alias("place"), s.alias("span"),
            F.substring(text, F.greatest(s["start"] - 19, F.lit(1)), F.least(s["start"], F.lit(20))).alias("left"),
            F.substring(text, s["start"] + 1, s["end"] - s["start"] + _REACH).alias("own"),
            F.substring(text, s["end"] + 1, F.lit(_REACH)).alias("right"),
            F.substring("masked", s["end"] + 1, F.lit(_REACH)).alias("marked"),
            F.substring("issuers", s["end"] + 1, F.lit(_REACH)).alias("issued"),
            F.transform(near, lambda o: F.struct((o["start"] - s["end"]).alias("start"), (o["end"] - s["end"]).alias("end"))).alias("near"),
            F.exists("spans", lambda o: (o["end"] <= s["start"]) & subject(o)).alias("preceded"),
        )

    return x.select("text_id", F.explode(F.transform("spans", context)).alias("c")).select("text_id", "c.*")


def _marker(markers: tuple, stop: str, within: int, text: str = "marked") -> Column:
    """Place and end, from the name's end on, of the first marker that ends before stop and within reach; null without one."""
    window = F.substring(F.col(text), F.lit(1), F.least(F.col(stop), F.lit(within)))
    at = F.regexp_instr(window, F.lit(f"({_any(markers)})"))
    size = F.length(F.regexp_extract(window, f"({_any(markers)})", 1))
    return F.when(at > 0, F.struct((at - 1).alias("at"), (at - 1 + size).alias("end")))


def _until(at: Column) -> Column:
    return F.substring(F.col("right"), F.lit(1), at)


def _is_subject(event: str) -> Column:
    """The name is the subject of the marker: said so by a particle or comma, or near enough, and no nearer name claims it."""
    at = F.col(event)["at"]
    between = _until(at)
    prefix, direct = F.rlike(between, F.lit(PREFIX)), F.rlike(between, F.lit(DIRECT))
    object_ = F.rlike("left", F.lit(TRAILING_RO)) | F.rlike(between, F.lit(TRAILING_RO))
    acquired = F.rlike(F.substring(F.col("right"), at + 1, F.lit(2)), F.lit(f"^({_any(ACQUISITION)})"))

    def claims(o: Column) -> Column:
        gap = F.substring(F.col("right"), o["end"] + 1, F.greatest(at - o["end"], F.lit(0)))
        close = at - o["end"] <= NEAR
        nearer = F.rlike(gap, F.lit(PREFIX)) | (~F.rlike(gap, F.lit(COUNTERPARTY)) & close)
        return (o["start"] < at) & ~(prefix & close & acquired) & nearer

    return ~F.rlike(between, F.lit(COUNTERPARTY)) & (prefix | direct | ((at <= NEAR) & ~object_)) & ~F.exists("near", claims)


def body_roles(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """texts and aliases as for dictionary.mentions(). One row a name in a text: text_id, place, mention_text, start, end, status, code, roles (structs
    of role, start, end of the evidence, by rank), names that are common words or titles left out. Only resolved names have roles."""
    c = _contexts(dictionary.mentions(texts, aliases))
    end = F.regexp_instr("right", F.lit(SENTENCE_END))
    also = F.locate(" 및 ", F.col("right"))
    c = c.withColumn("stop", F.when(end > 0, end - 1).otherwise(F.length("right")))
    c = c.withColumn("part", F.when(also > 0, F.least(F.col("stop"), also - 1)).otherwise(F.col("stop")))
    for name, markers, stop in (
        ("collaboration", (*CONTRACT, *COLLABORATION), "stop"), ("contract", CONTRACT, "stop"), ("issuer", ISSUER, "stop"), ("action", ACTION, "stop"), ("passive", PASSIVE, "part"),
        ("regulatory", REGULATORY, "part"), ("acquisition", ACQUISITION, "part"), ("selection", SELECTION, "part"), ("benefit", BENEFIT, "part"), ("adverse", ADVERSE, "part"),
    ):
        c = c.withColumn(name, _marker(markers, stop, WITHIN[name], "issued" if name == "issuer" else "marked"))
    free = lambda event: event.isNotNull() & ~F.exists("near", lambda o: o["start"] < event["at"])
    between = _until(F.col("collaboration.at"))
    partner = F.col("collaboration").isNotNull() & ~F.contains(between, F.lit("공동")) & ~F.rlike(between, F.lit(JOINT)) & F.rlike(between, F.lit(COUNTERPARTY))
    size, at = F.length("own") - F.length("right"), F.col("selection.at")
    # the four characters before the marker, which may reach into the name
    before = F.trim(F.substring(F.col("own"), F.greatest(size + at - 3, F.lit(1)), F.least(size + at, F.lit(4))))
    chosen = F.rlike("left", F.lit(TRAILING_RO)) | F.rlike(_until(at), F.lit(TRAILING_RO)) | F.endswith(before, F.lit("후보"))
    target = F.when(F.col("acquisition").isNotNull() & F.col("preceded"), F.col("acquisition")).otherwise(F.coalesce("passive", "regulatory", F.when(chosen, F.col("selection"))))
    c = c.withColumn("COUNTERPARTY", F.when(partner, F.col("collaboration"))).withColumn("target", target)
    c = c.withColumn("TARGET_", F.when(free(F.col("target")), F.col("target"))).withColumn("ISSUER_", F.when(_is_subject("issuer"), F.col("issuer")))
    alone = F.col("COUNTERPARTY").isNull() & F.col("TARGET_").isNull()
    c = c.withColumn("CONTRACTOR", F.when(alone & _is_subject("contract"), F.col("contract"))).withColumn("actor", F.when(alone & _is_subject("action"), F.col("action")))
    overlap = (F.col("actor.at") < F.col("ISSUER_.end")) & (F.col("ISSUER_.at") < F.col("actor.end"))
    c = c.withColumn("ACTOR_", F.when(~F.coalesce(overlap, F.lit(False)), F.col("actor")))
    gains = free(F.col("benefit")) & ~F.contains(_until(F.col("benefit.at")), F.lit("따른"))
    nearer = F.coalesce(F.least("ACTOR_.at", "CONTRACTOR.at", "ISSUER_.at") < F.col("benefit.at"), F.lit(False))
    c = c.withColumn("BENEFICIARY", F.when(gains & ~nearer, F.col("benefit"))).withColumn("ADVERSE_", F.when(free(F.col("adverse")), F.col("adverse")))
    start, name_end = F.col("span.start"), F.col("span.end")
    columns = ("ACTOR_", "ISSUER_", "CONTRACTOR", "COUNTERPARTY", "TARGET_", "BENEFICIARY", "ADVERSE_")
    role = [F.when(F.col(k).isNotNull(), F.struct(F.lit(r).alias("role"), start.alias("start"), (name_end + F.col(k)["end"]).alias("end"))) for r, k in zip(ROLES, columns, strict=False)]
    roles = F.when(F.col("span.status") == "RESOLVED", F.array_compact(F.array(*role)))
    roles = F.coalesce(roles, F.array().cast("array<struct<role: string, start: int, end: int>>"))
    text = F.substring(F.col("own"), F.lit(1), name_end - start)
    return c.select("text_id", "place", text.alias("mention_text"), start.alias("start"), name_end.alias("end"), F.col("span.status").alias("status"), F.col("span.code").alias("code"), roles.alias("roles"))


def listed_roles(references: DataFrame, companies: DataFrame, form: str) -> DataFrame:
    """references: text_id, kind (LEADER_LIST or MEMBERSHIP), place, name, code, quality. companies: code, known. Leaders and members as the source
    lists them: the role follows from the list, the status from the code alone (form: the pattern of a code)."""
    x = references.join(companies.select("code", F.coalesce("known", F.lit(False)).alias("known")).groupBy("code").agg(F.max("known").alias("known")), "code", "left")
    invalid = ~F.rlike("code", F.lit(f"^(?:{form})$")) | F.coalesce(F.col("quality") == "CODE_INVALID", F.lit(False))
    status = F.when(F.col("code").isNull(), "SOURCE_CODE_MISSING").when(invalid, "CODE_INVALID").when(F.coalesce("known", F.lit(False)), "RESOLVED").otherwise("UNKNOWN_STOCK_CODE")
    role = F.when(F.col("kind") == "LEADER_LIST", "LEADER").otherwise("RELATED")
    return x.withColumn("status", status).select(
        "text_id", "kind", "place", F.col("name").alias("mention_text"), "status", F.when(F.col("status") == "RESOLVED", F.col("code")).alias("code"), role.alias("suggested_role"),
        F.when(F.col("status") == "RESOLVED", role).alias("role"),
    )
