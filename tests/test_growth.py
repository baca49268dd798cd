"""Steps that must not grow faster than their input, and results that don't depend on the order of rows."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.functions import events
from tidemark.operators import cases, dictionary, linking, metrics
from tidemark.plans import history, periods, reads, textual


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_weights_read_no_frame_again(spark):
    """A frame from a row to the last one is read once a row: the square of a theme."""
    m = spark.createDataFrame([("t", i, float(c)) for i, c in enumerate([50, 20, 20, 5, 5])] + [("u", 9, None), ("u", 8, 1.0)], "theme_id string, stock_id long, cap double")
    w = metrics.capped_weights(m)
    assert "currentrow$(), unboundedfollowing$()" not in plan(w)
    got = {(r["theme_id"], r["stock_id"]): None if r["weight"] is None else round(r["weight"], 6) for r in w.collect()}
    assert got == {("t", 0): 0.3, ("t", 1): 0.28, ("t", 2): 0.28, ("t", 3): 0.07, ("t", 4): 0.07, ("u", 8): 0.5, ("u", 9): None}


def test_relevance_by_joins(spark):
    """What news and theme share comes from equality joins, not from reading a theme's stocks for every pair."""
    news = [(1, [7], [1, 1, 2], ["e"]), (2, [], [3], None), (3, [8, 8], [], []), (4, [], [2, 3], ["x"]), (5, None, [9], ["e"]), (6, [7], None, ["e"])]
    at = datetime(2024, 1, 5)
    n = spark.createDataFrame([(*x, at) for x in news], "news_id long, theme_ids array<long>, stocks array<long>, entities array<string>, published timestamp_ntz")
    c = spark.createDataFrame([(7, [1, 3], [2, 3], ["e"], datetime(2024, 1, 1), datetime(2024, 1, 9)), (8, [], [], [], datetime(2024, 1, 6), datetime(2024, 1, 9))], "theme_id long, leaders array<long>, related array<long>, entities array<string>, since timestamp_ntz, decision timestamp_ntz")
    r = linking.relevance(n, c)
    assert "arrays_overlap(stocks" not in plan(r) and "array_intersect" not in plan(r)
    got = {(x["news_id"], x["theme_id"]): (x["score"], x["counts"]) for x in r.collect()}
    assert got == {(1, 7): (1.0, True), (2, 7): (0.5, True), (3, 8): (0.35, False), (4, 7): (0.6, True), (6, 7): (0.6, True)}


def test_pairs_of_duplicates_come_once_without_a_shuffle_of_pairs(spark):
    rows = [(1, "p", 5, "abcd"), (2, "p", 5, "abcd"), (3, None, 5, "abcd"), (4, "q", 5, "abc"), (5, "q", 6, "abc")]
    d = spark.createDataFrame([(*r, "b") for r in rows], "id long, project string, signature long, text string, day string")
    pairs = linking.possible_duplicates(d, ["day"])
    assert "aggregate" not in plan(pairs)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (4, 5)]


def test_movers_at_a_bound(spark, tmp_path):
    """0.04 and 0.06 are 0.05 in the mean, whatever the order in which their doubles are added."""
    day = datetime(1998, 1, 5)
    spark.createDataFrame([(1, "A", x, day) for x in (0.06, 0.04)], "l_partkey long, l_returnflag string, l_discount double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "B")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in reads.q_day_movers_by_section(spark, str(tmp_path)).collect()] == [(date(1998, 1, 5), "A", 1, 0, "")]


def test_a_spelling_has_windows_by_validity_not_by_company(spark):
    """However many companies share a name, a text meets a few windows; the statuses stay as they are by all companies."""
    old, new = (date(2000, 1, 1), date(2000, 12, 31)), (date(2001, 1, 1), date(2001, 12, 31))
    rows = [("Big Name", f"{i:06d}", *(old, (None, date(1999, 1, 1)))[i % 2], True) for i in range(3000)] + [("big name", "x", *new, False), ("big  name", "x", *new, True), ("Lone", None, None, None, True), ("Both", None, None, None, True), ("both", "y", None, None, True)]
    rows += [("N" * 60, "long", None, None, True)]
    a = spark.createDataFrame(rows, "alias string, code string, valid_from date, valid_to date, known boolean")
    assert max(len(r["windows"]) for r in dictionary.names(a).collect()) == 3
    texts = [(1, "BIG NAME은 Lone both", date(2000, 5, 5)), (2, "a Big Name", date(2001, 5, 5)), (3, "big name", date(2005, 1, 1)), (4, "n" * 60 + " " + "n" * 61, None), (5, "bigname big", None)]
    got = {r["text_id"]: [tuple(x) for x in r["spans"]] for r in dictionary.mentions(spark.createDataFrame(texts, "text_id long, text string, as_of date"), a).collect()}
    assert got == {1: [(0, 8, "big name", "AMBIGUOUS_ALIAS", None), (10, 14, "lone", "RESOLVED", None), (15, 19, "both", "AMBIGUOUS_ALIAS", None)], 2: [(2, 10, "big name", "RESOLVED", "x")], 3: [(0, 8, "big name", "OUT_OF_VALIDITY", None)], 4: [(0, 60, "n" * 60, "RESOLVED", "long")]}


def test_similar_cases_make_no_rows_by_sets_or_leaders(spark):
    """A case is one row on its way to the best ones; the only rows made of it are those of its types. Shares beyond the sets count in full."""
    schema = "id long, theme string, day date, types array<string>, direction string, certainty string, leaders array<string>"
    rows = [(i, "t", date(2020, 1, 1 + i), ["x"], "UP", "CONFIRMED", list("ABCDEFGH"[: 8 - i])) for i in range(6)] + [(9, "t", date(2020, 2, 1), ["x"], "UP", "CONFIRMED", list("ABCDEF"))]
    x = cases.similar_cases(spark.createDataFrame(rows, schema), 2)
    made = [line for line in plan(x).splitlines() if "generate explode" in line]
    assert made and all("explode(types" in line for line in made)
    assert [(r["similar_id"], round(r["score"], 6), r["has_more"]) for r in x.where("id = 9").orderBy("place").collect()] == [(2, 1.0, True), (1, 1.0, True)]


def test_marks_are_compiled(spark):
    """Marks of a sentence are found without lambda functions, which aren't compiled and make anew what they go over."""
    t = spark.createDataFrame([(1, "of the der with aux again or by war is"), (2, ""), (3, None)], "id int, s string")
    x = t.select("id", events.types(F.col("s")).alias("t"), events.certainty(F.col("s")).alias("c"), events.direction(F.col("s")).alias("d"), events.continuation(F.col("s")).alias("k"), events.stage(F.col("s")).alias("g"), events.action(F.col("s")).alias("a"))
    assert "lambda" not in plan(x)
    got = {r["id"]: (r["t"], r["c"], r["d"], r["k"], r["g"], r["a"]["marker"]) for r in x.where("s is not null").collect()}
    assert got == {1: (["CONTRACT", "POLICY"], "CONFIRMED", "UP", "again", "COMPLETED", None), 2: (["OTHER"], "UNSPECIFIED", "UNKNOWN", None, "UNSPECIFIED", None)}


def test_texts_and_questions_are_spread(spark):
    """A row group of a file is one task: what is done with its rows has more."""
    d = "/root/testdata/sf0.001"
    for x in (textual.causes(spark, d), periods._questions(spark, d)):
        assert "hashpartitioning" in plan(x)


def test_outcomes_of_events_come_together_once(spark):
    x = plan(history.q_company_outcome(spark, "/root/testdata/sf0.001"))
    assert x.count("lineitem.parquet") == 2 and x.count("hashpartitioning(company") == 1
