"""Daily boards: grids with spans, missing end tags and nested tables, sections and narratives."""

from tidemark.sources import boards


def grid(html):
    out = {}
    for _, kind, text, board, row, col, *_ in boards.elements_of(html):
        if kind == "CELL":
            out.setdefault(board, {})[(row, col)] = text
    return out


def test_spans_fill_the_grid():
    html = "<table><tr><td rowspan=2>A</td><td colspan=2>B</td></tr><tr><td>C</td><td rowspan=9>D</td></tr><tr><td>E</td><td>F</td></tr></table>"
    assert grid(html) == {1: {(0, 0): "A", (0, 1): "B", (0, 2): "B", (1, 0): "A", (1, 1): "C", (1, 2): "D", (2, 0): "E", (2, 1): "F", (2, 2): "D"}}
    assert grid("<table><tr><td>a<td>b<tr><td rowspan=x>c<td colspan=0>d") == {1: {(0, 0): "a", (0, 1): "b", (1, 0): "c", (1, 1): "d"}}
    assert grid("<table><tr><td>x<table><tr><td>in</table>y<td>z</table>") == {2: {(0, 0): "in"}, 1: {(0, 0): "xy", (0, 1): "z"}}
    assert grid("<table><td>no row<td rowspan=99999999>b</table>") == {1: {(0, 0): "no row", (0, 1): "b"}}
    assert grid("no table") == {}


def test_lines_and_links():
    got = boards.elements_of("<p>one&nbsp; two<br>three<h2>four<table><tr><td><a href='u'>L <b>x</b><td>p</table>five")
    assert [(e[1], e[2]) for e in got] == [("LINE", "one two"), ("LINE", "three"), ("LINE", "four"), ("CELL", "L x"), ("CELL", "p"), ("LINE", "five")]
    assert got[3][6:] == (["u"], ["L x"])


def test_relations(spark):
    quotes = "<td>1,000<td>+2.5%<td>30<td>990<td>1010<td>980"
    pages = [
        (1, f"- One -<p>head<p>▷ d1<p>other<p>▷ d2<table><tr><th>테마명<th>종목명<tr><td><a href='/Theme/ThemeDB/5'>T</a><td>-1.0%<td><a href='?code=00000a'>S</a>{quotes}<tr><td><a href='?code=000002'>S2</a>{quotes}<tr><td>no link{quotes}<tr><td><a href='?code=000003'>S3</a><td>x<td>1%<td>2</table>"),
        (2, "Rise : strong demand<br>2024 : year<br>plain"),
        (3, ""),
        (4, None),
        (5, "<table><tr><td><a href='?code=000009'>alone</a></table>"),
    ]
    got = {}
    for r in sorted(boards.relations(spark.createDataFrame(pages, "page_id long, html string").repartition(2)).collect(), key=lambda r: (r["page_id"], r["place"])):
        got.setdefault(r["page_id"], []).append((r["kind"], r["section"], r["paragraph"], r["theme"], r["code"], r["close"], r["low"], None if r["theme_rate"] is None else float(r["theme_rate"])))
    assert got[1] == [
        ("DESCRIPTION", "One", 0, "One", None, None, None, None), ("SECTION_DETAIL", "One", 1, "One", None, None, None, None), ("SECTION_DETAIL", "One", 2, "One", None, None, None, None),
        ("THEME_STOCK", "One", None, "T", "00000A", 1000, 980, -1.0), ("THEME_STOCK", "One", None, "T", "000002", 1000, 980, -1.0), ("THEME_STOCK", "One", None, "T", "000003", None, None, -1.0),
    ]
    assert got[2] == [("DESCRIPTION", "테마시황", 0, "Rise", None, None, None, None), ("SECTION_DETAIL", "테마시황", 1, "테마시황", None, None, None, None), ("SECTION_DETAIL", "테마시황", 2, "테마시황", None, None, None, None)]
    assert got[5] == [("THEME_STOCK", None, None, None, "000009", None, None, None)] and set(got) == {1, 2, 5}


def test_plain_pages_read_once(spark):
    """A page passes through one reader, without a shuffle, and plain tags need no tolerant parser; both readers see the same."""
    plain = "- One -<p>a &amp; b<table><tr><td rowspan=2><a href='/s?x=1&code=000001'>S</a><td>1<tr><td>2</table>"
    odd = ["<!-- c -->" + plain, plain.upper(), plain.replace("&code", "&amp;code"), plain + "<script>x < y</script>", plain + "<td a='1>2'>z", plain + " < z", "<br/>" + plain]
    r = boards._Reader()
    assert r.read(plain)
    for html in odd:
        assert not boards._Reader().read(html)
    tolerant = boards._Reader()
    tolerant.feed(plain)
    tolerant.close()
    assert boards.elements_of(plain) == tolerant.out == r.out
    assert boards.elements_of(odd[0]) == boards.elements_of(odd[2]) == r.out
    pages = spark.createDataFrame([(1, plain), (2, "<p>x : y")], "page_id long, html string")
    plan = boards.relations(pages)._jdf.queryExecution().executedPlan().toString().lower()
    assert "exchange" not in plan and plan.count("mapinarrow") == 1
