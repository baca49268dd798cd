"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text with the elements around them. A logistic regression over text, links and the tree gives each block a log-odds
of being content: its capacity to one terminal. The regression is fitted on pages whose article element tells their content (a bounded sample), with and
without what tells it. Words of class, id and role that name content as well (discussion, related-work) count as boilerplate inside content only where links or
comments fill the element. Neighbouring blocks, and blocks whose elements stand near in the tree, are joined by smoothness edges of a like
size; a maximum flow finds the cheapest labelling.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, columns, least_hashes, rows_out

# Element names and the words that class, id and role attributes use for parts of a page.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SKIP = frozenset("script style noscript template textarea select button iframe object svg canvas head audio video datalist option title".split())
#: What may stand in a head (anything else ends it), what is read as raw text, and places inside svg where HTML may stand.
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_RAW = frozenset("iframe noscript script style template textarea title".split())
_FOREIGN = frozenset("desc foreignobject title".split())
_PAIRED = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1|<(/?)(audio|button|canvas|datalist|iframe|noscript|object|option|select|svg|template|textarea|title|video)\b[^>]*?(/?)>", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_OUTSIDE = frozenset("nav aside form footer menu dialog fieldset".split())
_CONTENT = frozenset("article main".split())
_BAD = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget alert complementary contentinfo".split())
_GOOD = frozenset("article body content entry main maincontent post story text".split())
#: Words of _BAD that name real content as well: as a class or role, and (any word a heading may turn into) as an id.
_AMBIGUOUS = frozenset("alert discussion disclaimer header notice recommended related respond search tags".split())
_TOPIC = _AMBIGUOUS | frozenset("advertising banner complementary consent cookie cookies footer form login menu navigation overlay replies reply share sharing social sponsor widget".split())
_COMMENT = frozenset("comment comments disqus".split())
#: Parts beside a bad word that leave its meaning (sidebar-left, site-footer), and first parts that say what a page is about or has.
_PLAIN = frozenset("area articles bar block body bottom box btn button buttons center col column container content div element entry group head icons inner item items left link links list main outer page panel post posts primary right secondary section site slot thread title top unit wrap wrapper".split())
_ABOUT = frozenset("author cat category format has no status tag tagged taxonomy term topic type with without".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAF = _HEADING | frozenset("p li td th dd dt tr blockquote pre".split())
_LAYOUT = frozenset("article aside center dir div footer form header main menu nav ol table ul".split())
#: An ambiguous element is boilerplate where so much of its text lies in links or in comments below it.
AGREED = 0.5

#: What a block's log-odds are linear in. From the elements around it (counts, at most 2): content (inside article or main), outside (below nav, aside,
#: footer, ...), bad (below boilerplate words), around (either of them, but around the article) and good (below content words). From the block
#: itself: share of link text, size, element, copyright line, an end of a sentence. company: how much text outside links its container holds.
FEATURES = ("bias", "content", "outside", "bad", "around", "good", "links", "words", "paragraph", "heading", "item", "copyright", "sentence", "company")
#: Log-odds to start from, and all there is where no page of the sample tells its content; the fit may move them.
PRIOR = (0.1, 1.5, -4.0, -4.5, -0.5, 0.5, -2.5, 0.6, 0.4, 0.2, -0.3, -1.2, 0.2, 0.3)
#: Pages of the sample, blocks of each, and the ridge that holds the weights to PRIOR.
PAGES, BLOCKS, RIDGE = 256, 64, 40.0
#: Smoothness between neighbours and between neighbours in one element (both shrink with the square of the distance in the tree); part of it across a landmark.
BESIDE, NEAR, ACROSS = 1.5, 0.75, 0.2
#: No log-odds count for more than this, so that neighbours can outvote any block.
MOST = 6.0


def _marks(tag: str, attrs: list) -> tuple[frozenset, frozenset, frozenset]:
    """Words of class, id and role that tell boilerplate, those that may tell it, and those that tell content."""
    clear, weak, good = set(), set(), set()
    slug = tag not in _LAYOUT or any(k == "class" and v and "section" in v.lower().split() for k, v in attrs)
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower():
            clear.add("overlay")
        if k not in ("class", "id", "role") or not v:
            continue
        for token in v.lower().split():
            parts = "".join(c if c.isalnum() else " " for c in token).split()
            good.update(_GOOD.intersection(parts))
            bad = _BAD.intersection(parts)
            if not bad or k == "id" and tag in _HEADING or len(parts) > 1 and parts[0] in _ABOUT:
                continue
            sure = bad - (_TOPIC if k == "id" else _AMBIGUOUS if k == "class" else {"alert"})
            whole = all(p in bad or p in _PLAIN or p.isdigit() for p in parts) or parts[0] in _COMMENT
            if sure and whole and not (k == "id" and slug):
                clear |= sure
            else:
                weak |= bad
    return frozenset(clear), frozenset(weak), frozenset(good)


class _Element:
    """An open or closed block element: words of its attributes, and what its place in the tree says of the blocks below it."""

    __slots__ = ("bad", "clear", "content", "depth", "good", "here", "held", "landmark", "linked", "maybe", "number", "parent", "size", "soft", "tag", "told", "weak")

    def __init__(self, tag: str, parent: "_Element | None", number: int, clear: frozenset = frozenset(), weak: frozenset = frozenset(), good: frozenset = frozenset()):
        self.tag, self.parent, self.number, self.clear, self.weak, self.good = tag, parent, number, clear, weak, good
        self.depth = parent.depth + 1 if parent else 0
        self.size = self.linked = self.told = 0  # characters below; those in links; those in links or comments
        self.bad = bool(clear)


def _unclosed(html: str) -> set[tuple[str, int]]:
    """(name, number among the start tags of that name) of elements whose text is skipped and that no end tag closes."""
    count: Counter = Counter()
    waiting: dict[str, list[int]] = defaultdict(list)
    for m in _PAIRED.finditer(html):
        if m[3]:
            tag = m[3].lower()
            if m[2]:
                if waiting[tag]:
                    waiting[tag].pop()
            else:
                count[tag] += 1
                if not m[4]:
                    waiting[tag].append(count[tag])
    return {(tag, k) for tag, open_ones in waiting.items() for k in open_ones}


class _Reader(HTMLParser):
    """Blocks in page order: (text, link characters, element).

    Head and body tags may be missing: what can't stand in a head ends it. An element whose text is skipped ends at its end tag, or with
    the element around it; svg at a block; one without an end tag at the next block.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.unclosed = _unclosed(html)
        self.seen: Counter = Counter()
        self.loose: list[bool] = []  # of each skipped element that is open: no end tag closes it
        self.inner: Counter = Counter()  # other elements opened inside the skipped ones
        self.elements = [_Element("html", None, 0)]
        self.stack = self.elements[:]
        self.open: Counter = Counter()
        self.skip: list[str] = []
        self.in_link = False
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[str, int, _Element]] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                e = self.stack[-1]
                e.size += len(text)
                e.told += min(self.linked, len(text))
                self.blocks.append((text, self.linked, e))
            self.parts, self.linked = [], 0

    def _close(self, tag: str, stop: frozenset = frozenset()) -> None:
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                for e in self.stack[i:]:
                    self.open[e.tag] -= 1
                del self.stack[i:]
                return
            if self.stack[i].tag in stop:
                return

    def _leave(self, depth: int) -> None:
        """Skipped elements from the depth-th on end."""
        del self.skip[depth:], self.loose[depth:]
        if not self.skip:
            self.inner.clear()

    def _skips(self, tag: str) -> None:
        self.skip.append(tag)
        self.loose.append((tag, self.seen[tag]) in self.unclosed)

    def handle_starttag(self, tag, attrs):
        self.seen[tag] += 1
        while self.skip:
            top = self.skip[-1]
            if top == "head":
                ends = tag not in _HEAD
            elif top == "svg":
                ends = tag in _BLOCK and not any(self.inner[t] for t in _FOREIGN)
            else:
                ends = self.loose[-1] and tag in _BLOCK
            if not ends:
                break
            self._leave(len(self.skip) - 1)
        if self.skip:
            if tag in _SKIP and not (self.skip[-1] == "svg" and tag == "title"):
                self._skips(tag)
            elif tag not in _VOID:
                self.inner[tag] += 1
            return
        if tag in _SKIP:
            self._skips(tag)
            self.parts.append(" ")
            return
        if tag in _BLOCK:
            self.flush()
            self.in_link = False
            if tag != "hr":
                self._close("p", frozenset(("article", "section", "div", "td", "li")))
                if tag in ("li", "dd", "dt", "td", "th", "tr"):
                    for t in {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}[tag]:
                        self._close(t, frozenset(("ul", "ol", "menu", "dl", "table", "div", "section")))
                e = _Element(tag, self.stack[-1], len(self.elements), *(_marks(tag, attrs) if attrs else ()))
                self.elements.append(e)
                self.stack.append(e)
                self.open[tag] += 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.in_link = True

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                self._leave(len(self.skip) - 1 - self.skip[::-1].index(tag))
                return
            if self.inner[tag]:
                self.inner[tag] -= 1
                return
            if not (self.open[tag] or tag in ("body", "html")) or self.skip[-1] in _RAW and not self.loose[-1]:
                return
            self._leave(0)
        if tag in _BLOCK:
            self.flush()
            self._close(tag)
        elif tag == "a":
            self.in_link = False

    def handle_data(self, data):
        if self.skip == ["head"] and not data.isspace():
            self._leave(0)
        if not self.skip:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data)


def read(html: str) -> list[tuple[str, int, _Element]]:
    """The blocks of a page; their elements know what is around them. One pass down and one up the tree, whatever its depth."""
    reader = _Reader(html)
    reader.feed(html)
    reader.close()
    reader.flush()
    for e in reversed(reader.elements):
        # ambiguous words tell boilerplate where links or comments fill the element
        if e.weak and not e.bad and e.told >= AGREED * e.size > 0:
            e.bad = True
        if e.parent:
            e.parent.size += e.size
            e.parent.told += e.told if _COMMENT.isdisjoint(e.clear) else e.size
    has_content = any(e.tag in _CONTENT and not e.bad and e.size for e in reader.elements)
    for e in reader.elements:
        up = e.parent
        # content: inside the article; here: outside or bad below it; soft: around it; maybe: ambiguous, unless an article follows
        e.content, e.here, e.soft, e.maybe, e.held, e.landmark = (up.content, up.here, up.soft, up.maybe, up.held, up.landmark) if up else (False, (0, 0, 0), 0, 0, False, 0)
        outside, bad, good = e.here
        if e.tag in _CONTENT and not e.bad:
            e.content, e.soft, e.maybe, e.landmark = True, e.soft + outside + bad, 0, e.number
            outside = bad = 0
        elif e.tag in _OUTSIDE or e.tag == "header" and not e.content:
            outside, e.landmark = outside + 1, e.number
        elif e.bad and e.tag not in ("html", "body", "header"):
            bad, e.landmark = bad + 1, e.number
        elif e.weak and not e.content and (has_content or not e.held and not e.weak <= _AMBIGUOUS) and e.tag not in ("html", "body"):
            e.maybe, e.landmark = e.maybe + 1, e.number
        elif e.good and up:
            good, e.held = good + 1, True
        e.here = (outside, bad, good)
    return reader.blocks


def _container(e: _Element) -> _Element:
    return e.parent if e.parent and e.tag in _LEAF else e


def block_features(text: str, linked: int, e: _Element) -> list[float]:
    outside, bad, good = e.here
    place = _container(e)
    n = text.count(" ") + 1
    return [
        1.0,
        float(e.content),
        float(min(outside, 2)),
        float(min(bad + e.maybe, 2)),
        float(min(e.soft, 2)),
        float(min(good, 2)),
        min(1.0, linked / len(text)),
        min(1.5, math.log2(n) / 3 - 1),
        float(e.tag == "p"),
        float(e.tag in _HEADING),
        float(e.tag == "li"),
        float("\u00a9" in text and n < 40),
        float(text[-1] in ".!?\u2026"),
        min(1.5, math.log2(1 + place.size - place.told) / 6 - 1),
    ]


def minimum_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: a node against its lean costs |lean|, a cut edge its weight.

    Maximum flow by blocking flows over levels; the source's side of the last levels is content.
    """
    n = len(lean)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a, b, there, back):
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(lean):
        if x > 0:
            arc(source, i, x, 0.0)
        elif x < 0:
            arc(i, sink, -x, 0.0)
    for a, b, weight in edges:
        arc(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for k in head[a]:
                if room[k] > 1e-9 and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    queue.append(to[k])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[k] for k in path)
                first = None
                for i, k in enumerate(path):
                    room[k] -= flow
                    room[k ^ 1] += flow
                    if first is None and room[k] <= 1e-9:
                        first = i
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            arcs = head[a]
            while following[a] < len(arcs):
                k = arcs[following[a]]
                if room[k] > 1e-9 and level[to[k]] == level[a] + 1:
                    break
                following[a] += 1
            else:
                if a == source:
                    break
                a = to[path.pop() ^ 1]
                following[a] += 1
                continue
            path.append(k)
            a = to[k]


def _distance(a: _Element, b: _Element, most: int = 8) -> int:
    """Steps between two elements in the tree; `most` if there are more."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def _edges(blocks: list[tuple[str, int, _Element]]) -> list[tuple[int, int, float]]:
    """Smoothness: each block with the one before it, and with the last before that in its container or its container's parent."""
    edges, last = [], {}
    before = None
    for i, (_, _, e) in enumerate(blocks):
        place = _container(e)
        part = lambda other: 1.0 if other.landmark == place.landmark else ACROSS  # noqa: E731, B023
        if before is not None:
            edges.append((i - 1, i, BESIDE * part(before) / (1 + _distance(before, place)) ** 2))
        for away, x in enumerate((place, place.parent)):
            if x is None:
                continue
            j, other = last.get(x.number, (i, place))
            if j < i - 1:
                edges.append((j, i, NEAR * part(other) / (1 + 2 * away) ** 2))
            last[x.number] = (i, place)
        before = place
    return edges


def log_odds(blocks: list[tuple[str, int, _Element]], weights: np.ndarray) -> list[float]:
    if not blocks:
        return []
    return np.clip(np.array([block_features(*b) for b in blocks]) @ weights, -MOST, MOST).tolist()


def main_text(html: str | None, weights: np.ndarray | None = None) -> str:
    if not html:
        return ""
    blocks = read(html)
    keep = minimum_cut(log_odds(blocks, np.array(PRIOR) if weights is None else weights), _edges(blocks))
    return "\n".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)


def examples(html: str) -> list[tuple[list[float], float]]:
    """Blocks (BLOCKS at most, spread over the page) with labels, of a page whose article tells its content: once as they are, and once as if
    nothing around them told. Empty if no article holds half of the page's text outside links."""
    blocks = read(html)
    told = [(b, bool(b[2].content and not any(b[2].here[:2]))) for b in blocks]
    weight = [max(0, len(b[0]) - b[1]) for b, _ in told]
    if 2 * sum(w for w, (_, y) in zip(weight, told, strict=True) if y) < sum(weight) or not any(y for _, y in told):
        return []
    step = max(1, -(-len(told) // BLOCKS))
    out = []
    for b, y in told[::step]:
        x = block_features(*b)
        out += [(x, float(y)), ([x[0], 0.0, 0.0, 0.0, 0.0, 0.0, *x[6:]], float(y))]
    return out


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression held to PRIOR by a ridge, by Newton steps. Its log-odds are the capacities."""
    w0 = np.array(PRIOR)
    w = w0.copy()
    for _ in range(25 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (p - y) + RIDGE * (w - w0))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learned(pages: DataFrame) -> np.ndarray:
    """Weights fitted on PAGES pages of least hash: a bound on the sample, at every size. Only features reach the driver."""
    out = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.float64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            (html,) = columns(batch, "html")
            rows = [r for h in html for r in examples(h)]
            if rows:
                yield rows_out(out, *zip(*rows, strict=True))

    some = least_hashes(pages.where("html is not null and html <> ''").select("html"), PAGES)
    rows = some.mapInArrow(run, "x array<double>, y double").collect()
    # rows in one order: the sums of the fit, and so its last digits, depend on it
    rows = sorted((tuple(r["x"]), r["y"]) for r in rows)
    return fit_weights(np.array([r[0] for r in rows]).reshape(len(rows), len(PRIOR)), np.array([r[1] for r in rows]))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text).

    Null and empty html give an empty text; so does a page without content. A line break element is white space
    in its block. Rows that repeat a page_id are read each by itself; other columns play no part. Pages of any length are read whole, in
    time near proportion to their elements and blocks; an empty table gives no rows.
    """
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = learned(rows)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, urls, html = columns(batch, "page_id", "url", "html")
            for at in range(0, len(ids), 500):
                yield rows_out(out, ids[at : at + 500], urls[at : at + 500], [main_text(h, weights) for h in html[at : at + 500]])

    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
