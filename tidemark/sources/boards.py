"""Daily boards as HTML: sections with a headline and details, and tables of themes and stocks, as rows.

A small helper turns a page into its elements in order: lines of text outside tables, and cells on a grid in which rowspan and colspan are
filled in (end tags may be missing, tables may be nested). What goes on from element to element of a page (sections, themes) is carried there,
so that a page is read once and nothing is shuffled; what a row's cells mean are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that break lines, how sections, details and links look, and the quotes of a row by the number of its cells.
BLOCKS = frozenset("div h1 h2 h3 h4 li p section table tr".split())
SECTION, DETAIL, MARKET_SECTION = r"^-\s*(.+?)\s*-$", "▷", "테마시황"
_LAST = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
THEME_LINK, STOCK_LINK = rf"/Theme/ThemeDB/(\d+)(?:[/?#]|{_LAST})", rf"[?&]code=([0-9A-Z]{{6}})(?:[&#]|{_LAST})"
NARRATIVE = r"^(.{2,40}?)\s*:\s*(.+)$"
HEADER = "종목명"
QUOTES = {7: ("close", "change_rate", "volume", "open", "high", "low"), 4: ("close", "change_rate", "volume")}
MOST_SPAN = 1000
RATE, MOST_RATE = r"^([+-]?[0-9]+(?:\.[0-9]+)?)\s*%$", Decimal("99999999.99995")  # what a decimal(12,4) holds
_WIDE = frozenset(n + 2 for n in QUOTES)
_section, _narrative, _percent = re.compile(SECTION), re.compile(NARRATIVE), re.compile(RATE)
_theme_link, _stock_link = re.compile(THEME_LINK, re.ASCII | re.IGNORECASE), re.compile(STOCK_LINK, re.ASCII | re.IGNORECASE)
# tags as most pages have them; what isn't of this form (capitals, comments, references in attributes, open quotes, ...) or holds raw text goes through the tolerant parser
_TAG = re.compile(r"""<(?:/([a-z][a-z0-9]*)|([a-z][a-z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z]+=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`&/]+))*))>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z]+)=("[^"]*"|'[^']*'|[^\s"']+)""")
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())
_ROW = "place int, kind string, section string, paragraph long, theme string, rate string, stock string, code string, own array<string>, text string"
_AT_ONCE = 8192  # rows a batch


def _clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())  # splits at no-break spaces too


class _Board:
    """One open table: the row and cell being read, and cells that reach down from rows above."""

    def __init__(self, number: int):
        self.number, self.row, self.col = number, -1, 0
        self.cell: dict | None = None
        self.below: dict[int, tuple[int, dict]] = {}  # by column: rows still to fill, and the cell


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.line: list[str] = []
        self.boards: list[_Board] = []
        self.count = 0

    def _end_line(self) -> None:
        if self.line:
            text, self.line = _clean(self.line), []
            if text:
                self.out.append((len(self.out), "LINE", text, 0, 0, 0, [], []))

    def _put(self, b: _Board, cell: dict) -> None:
        self.out.append((len(self.out), "CELL", cell["text"], b.number, b.row, b.col, cell["hrefs"], cell["labels"]))
        b.col += 1

    def _end_link(self, cell: dict) -> None:
        cell["hrefs"].append(cell["href"])
        cell["labels"].append(_clean(cell["label"]))
        cell["href"] = None

    def _fill(self, b: _Board) -> None:
        """Cells from above that stand at the next columns."""
        while b.col in b.below:
            left, cell = b.below[b.col]
            if left <= 1:
                del b.below[b.col]
            else:
                b.below[b.col] = (left - 1, cell)
            self._put(b, cell)

    def _end_cell(self, b: _Board) -> None:
        if b.cell is None:
            return
        cell, b.cell = b.cell, None
        if cell["href"] is not None:
            self._end_link(cell)
        cell["text"] = _clean(cell["parts"])
        if b.below:
            self._fill(b)
        for _ in range(cell["wide"]):
            if cell["tall"] > 1:
                b.below[b.col] = (cell["tall"] - 1, cell)
            self._put(b, cell)

    def _end_row(self, b: _Board) -> None:
        self._end_cell(b)
        if b.row >= 0:
            self._fill(b)

    def read(self, html: str) -> bool:
        """The page by its tags alone; false, with nothing of worth read, if it isn't made of plain tags and text."""
        parts = _TAG.split(html)  # text, end tag, start tag, its attributes, text, ...
        if "<" in "".join(parts[::4]) or not _RAW.isdisjoint(parts[2::4]):
            return False
        for text, ended, tag, attributes in zip(parts[::4], [*parts[1::4], None], [*parts[2::4], None], [*parts[3::4], None], strict=True):
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            if tag:
                if attributes and "&" in attributes and unescape(attributes) != attributes:
                    return False
                self.handle_starttag(tag, [(k.lower(), v[1:-1] if v[0] in "\"'" else v) for k, v in _ATTRIBUTE.findall(attributes)] if attributes else ())
            elif ended:
                self.handle_endtag(ended)
        return True

    def handle_starttag(self, tag, attrs):
        if self.line and (tag == "br" or tag in BLOCKS):
            self._end_line()
        b = self.boards[-1] if self.boards else None
        if tag == "table":
            self.count += 1
            self.boards.append(_Board(self.count))
        elif b and tag == "tr":
            self._end_row(b)
            b.row, b.col = b.row + 1, 0
        elif b and tag in ("td", "th"):
            self._end_cell(b)
            b.row = max(b.row, 0)
            b.cell = {"parts": [], "hrefs": [], "labels": [], "href": None, "tall": 1, "wide": 1}
            if attrs:
                at = dict(attrs)
                for name, span in (("tall", at.get("rowspan")), ("wide", at.get("colspan"))):
                    if span and span.isdecimal() and int(span) > 0:
                        b.cell[name] = min(MOST_SPAN, int(span))
        elif b and tag == "a" and b.cell:
            b.cell["href"], b.cell["label"] = dict(attrs).get("href") or "", []

    def handle_endtag(self, tag):
        b = self.boards[-1] if self.boards else None
        if b and tag == "a" and b.cell and b.cell["href"] is not None:
            self._end_link(b.cell)
        elif b and tag in ("td", "th"):
            self._end_cell(b)
        elif b and tag == "tr":
            self._end_cell(b)
        elif b and tag == "table":
            self._end_row(b)
            self.boards.pop()
        if tag in BLOCKS:
            self._end_line()

    def handle_data(self, data):
        if not self.boards:
            self.line.append(data)
            return
        cell = self.boards[-1].cell
        if cell:
            cell["parts"].append(data)
            if cell["href"] is not None:
                cell["label"].append(data)


def elements_of(html: str) -> list[tuple]:
    """(place, LINE or CELL, text, board, row, column, hrefs, link labels) of a page."""
    r = _Reader()
    if not r.read(html):
        r = _Reader()
        r.feed(html)
        r.close()
    while r.boards:
        r.handle_endtag("table")
    r._end_line()
    return r.out


def _holds(text: str) -> bool:
    m = _percent.match(text)
    return m is not None and Decimal(m[1]).copy_abs() < MOST_RATE


def rows_of(html: str) -> list[tuple]:
    """(place, kind, section, paragraph, theme, cell with the theme's rate, stock, code, cells of the quotes, text) of a page, see relations()."""
    out, lines, section, structured = [], [], None, False
    tables: dict[tuple[int, int], tuple[int, str | None, list, list]] = {}
    nth, first = 0, True
    for place, kind, text, board, row, _, hrefs, labels in elements_of(html):
        if kind == "CELL":
            structured = True
            if (line := tables.get((board, row))) is None:
                line = tables[board, row] = (place, section, [], [])
            line[2].append(text)
            if hrefs:
                line[3].extend(zip(hrefs, labels, strict=True))
        elif m := _section.match(text):
            structured, section, nth, first = True, m[1], 0, True
        elif section is None:
            lines.append((place, text))
        else:
            if text.startswith(DETAIL):
                nth += 1
                out.append((place, "SECTION_DETAIL", section, nth, section, None, None, None, None, text))
            elif first:
                out.append((place, "DESCRIPTION", section, 0, section, None, None, None, None, text))
            first = False
    if not structured:
        for place, text in lines:
            m = None if "0" <= text[0] <= "9" else _narrative.match(text)
            nth += m is None
            out.append((place, "DESCRIPTION" if m else "SECTION_DETAIL", MARKET_SECTION, 0 if m else nth, m[1] if m else MARKET_SECTION, None, None, None, None, text))
    carried: dict[int, tuple[str | None, str | None]] = {}
    for (board, _), (place, above, texts, links) in tables.items():
        text = "\t".join(filter(None, texts))
        if HEADER in text:
            continue
        theme, rate = carried.get(board, (None, None))
        stock = code = None
        for href, label in links:
            if label and _theme_link.search(href):
                theme = label
            if label and (m := _stock_link.search(href)):
                stock, code = label, m[1].upper()
        wide = len(texts) in _WIDE
        if wide and stock is not None and _holds(texts[1]):
            rate = texts[1]
        carried[board] = (theme, rate)
        if stock is not None:
            out.append((place, "THEME_STOCK", above, None, above if theme is None else theme, rate, stock, code, texts[2:] if wide else texts, text))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
    names = ["page_id", *(c.split()[0] for c in _ROW.split(", "))]
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("page_id"))
        at, out = [], []
        for i, html in enumerate(batch.column(batch.schema.get_field_index("html")).to_pylist()):
            if html and (rows := rows_of(html)):
                at += [i] * len(rows)
                out += rows
            if out and (len(out) >= _AT_ONCE or i == len(ids) - 1):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=names)
                at, out = [], []


def _rate(text: Column) -> Column:
    """+21.00% as a number; null for anything else."""
    return F.when(F.rlike(text, F.lit(RATE)), F.regexp_replace(text, r"[+%\s]", "")).try_cast("decimal(12,4)")


def _whole(text: Column) -> Column:
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(F.rlike(plain, F.lit("^[0-9]+$")), plain).try_cast("long")


def relations(pages: DataFrame) -> DataFrame:
    """pages: page_id, html. page_id, place, kind, section, paragraph, theme, theme_rate, stock, code, close, change_rate, volume, open, high, low, text.

    DESCRIPTION: a section's headline (its first line that is no detail). SECTION_DETAIL: its details, numbered. THEME_STOCK: a table's row with a link to a stock, under the
    theme last linked in the table and the section last headed before it; quotes are null unless all cells of a known layout are numbers. A page without sections and
    tables is a narrative: 'theme : reason' lines are DESCRIPTION, the others SECTION_DETAIL of the market section.
    """
    rows = pages.select("page_id", "html").mapInArrow(_read, f"page_id {dict(pages.dtypes)['page_id']}, {_ROW}")
    for n, names in QUOTES.items():
        parsed = [(_rate if c == "change_rate" else _whole)(F.get("own", F.lit(i))) for i, c in enumerate(names, 1)]
        known = F.size("own") == n
        for p in parsed:
            known = known & p.isNotNull()
        rows = rows.withColumn(f"quote_{n}", F.when(known, F.struct(*[p.alias(c) for p, c in zip(parsed, names, strict=True)])))
    quote = lambda c: F.coalesce(*[F.col(f"quote_{n}")[c] for n, names in QUOTES.items() if c in names]).alias(c)
    return rows.select("page_id", "place", "kind", "section", "paragraph", "theme", _rate(F.col("rate")).alias("theme_rate"), "stock", "code", *[quote(c) for c in QUOTES[7]], "text")
