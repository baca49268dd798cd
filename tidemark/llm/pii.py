"""Personal data: fixed patterns, and spans that a character BiLSTM with CRF transitions adds.

The tagger is trained in numpy from labelled spans: those that the patterns find in a bounded sample of the corpus, the same spans in ways of
writing that the patterns miss (user (at) host dot org, 10[.]0[.]0[.]1, dotted cards, national phone numbers), and made-up ones of
either sort planted into other stretches. Every kind, in every such way, has a digit, an @ or the word dot in it, so only windows around these are
tagged; such windows cover all of them in every whole text. Windows overlap by half, so a span of up to SPAN / 2 characters lies whole in one; a
longer one that every window cuts is decoded again in wider ones, until one sees it whole. Spans are reconciled over the whole text by best total
score.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, columns, least_hashes, rows_out

KINDS = ("email", "ip", "card", "phone")
#: Training contexts: so many documents, and of each so many stretches of so many characters, from anywhere in its text; and as many documents
#: that hold personal data, one stretch around it of each. No more of the corpus is seen in training, at any size; tagging reads all of it.
SAMPLE, STRETCHES, STRETCH = 256, 8, 250
EXAMPLES, EPOCHS, HIDDEN, SPAN = 3072, 8, 16, 64
#: Tagged spans of fewer characters are dropped: no card, phone number or address of four numbers is shorter, and shorter e-mail addresses are the fixed pattern's.
SHORTEST = 7
#: A tagged span must beat "nothing" by this much on average.
MARGIN = 0.1
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]|\b[Dd][Oo][Tt]\b")
#: Roughly the fixed patterns, to find documents to learn from.
_LIKELY = r"[A-Za-z0-9]@[A-Za-z0-9-]+[.]|[0-9][.][0-9]+[.][0-9]+[.][0-9]|[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|[+][0-9][0-9 ().-]{8}"
#: What may be personal data, in any way of writing: words with an @, long numbers, dotted fours.
_OWN = re.compile(r"[^\s@]*+@\S*|[+(]?[0-9](?:[ ().-]{0,3}[0-9]){6,}|[0-9]++(?:\.[0-9]++){3}")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed. Linear in the text."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > floor and text[lo - 1] in _LETTERS:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end(), "email"))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- tagger ------------------------------------------------------------------------------------

_TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
_CHARS = 131


def _codes(text: str, n: int) -> np.ndarray:
    """ASCII as is, 128 other letters, 129 anything else, 130 beyond the end."""
    out = np.full(n, 130, np.int64)
    out[: len(text)] = [ord(c) if c < "\x80" else 128 if c.isalpha() else 129 for c in text[:n]]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Forward and backward LSTM over characters, a linear layer to tag scores, CRF transitions."""

    def __init__(self, rng: np.random.Generator, hidden: int = HIDDEN):
        h, f = hidden, np.float32
        self.h = h
        self.p = {"out": rng.normal(0, 0.2, (2 * h, _TAGS)).astype(f), "bias": np.zeros(_TAGS, f), "move": np.zeros((_TAGS, _TAGS), f)}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (_CHARS, 4 * h)).astype(f)
            self.p["u" + d] = rng.normal(0, 0.25, (h, 4 * h)).astype(f)
            self.p["x" + d][:, h : 2 * h] += 1  # remember at first
        inside = [2 + 2 * k for k in range(len(KINDS))]
        for i in inside:  # inside follows begin or inside of its kind only
            self.p["move"][:, i] = -8
            self.p["move"][[i - 1, i], i] = 0

    def _run(self, codes: np.ndarray, d: str, keep: bool = True) -> tuple[np.ndarray, list]:
        h, n, t = self.h, *codes.shape
        x, u, y, c = self.p["x" + d], self.p["u" + d], np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.empty((n, t, h), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            g = x[codes[:, i]] + y @ u
            s = _sigmoid(g[:, : 3 * h])
            new = np.tanh(g[:, 3 * h :])
            before, was = c, y
            c = s[:, h : 2 * h] * c + s[:, :h] * new
            th = np.tanh(c)
            y = s[:, 2 * h :] * th
            out[:, i] = y
            if keep:
                kept.append((i, s, new, before, th, was))
        return out, kept

    def scores(self, codes: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(codes, "f", False)[0], self._run(codes, "b", False)[0]], 2)
        return both @ self.p["out"] + self.p["bias"]

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> dict:
        n, t = codes.shape
        (f, kf), (b, kb) = self._run(codes, "f"), self._run(codes, "b")
        both = np.concatenate([f, b], 2)
        e, m = both @ self.p["out"] + self.p["bias"], self.p["move"]
        lse = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
        a, z = np.empty_like(e), np.empty_like(e)
        a[:, 0], z[:, -1] = e[:, 0], 0
        for i in range(1, t):
            a[:, i] = e[:, i] + lse(a[:, i - 1, :, None] + m, 1)
            z[:, t - 1 - i] = lse(m + (e[:, t - i] + z[:, t - i])[:, None, :], 2)
        total = lse(a[:, -1], 1)[:, None, None]
        de = np.exp(a + z - total)
        pair = np.exp(a[:, :-1, :, None] + m + (e + z)[:, 1:, None, :] - total[..., None]).sum((0, 1))
        rows, steps = np.arange(n)[:, None], np.arange(t)
        de[rows, steps, tags] -= 1
        np.subtract.at(pair, (tags[:, :-1], tags[:, 1:]), 1)
        de /= n
        grad = {"out": both.reshape(-1, 2 * self.h).T @ de.reshape(-1, _TAGS), "bias": de.sum((0, 1)), "move": pair / n}
        dy = de @ self.p["out"].T
        hot = (codes.reshape(-1, 1) == np.arange(_CHARS)).astype(np.float32)
        for d, kept, part in (("f", kf, dy[:, :, : self.h]), ("b", kb, dy[:, :, self.h :])):
            h, u = self.h, self.p["u" + d]
            gates, gu = np.empty((n, t, 4 * h), np.float32), np.zeros_like(u)
            back, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for i, s, new, before, th, was in reversed(kept):
                y = part[:, i] + back
                dc = dc + y * s[:, 2 * h :] * (1 - th * th)
                ds = np.concatenate([dc * new, dc * before, y * th], 1) * s * (1 - s)
                g = np.concatenate([ds, dc * s[:, :h] * (1 - new * new)], 1)
                gu += was.T @ g
                gates[:, i] = g
                back, dc = g @ u.T, dc * s[:, h : 2 * h]
            grad["x" + d], grad["u" + d] = hot.T @ gates.reshape(-1, 4 * h), gu
        return grad

    def train(self, codes: np.ndarray, tags: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS) -> None:
        first, second, step = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, 0
        first, second = first
        for epoch in range(epochs):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), 64):
                step += 1
                for k, g in self.gradient(codes[order[at : at + 64]], tags[order[at : at + 64]]).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    rate = 0.02 * (1 - 0.8 * epoch / epochs)
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag path of each row, and how much each position's tag, and the move to it, beats none."""
        e, m = self.scores(codes), self.p["move"]
        n, t, _ = e.shape
        best, back = e[:, 0], np.empty((n, t, _TAGS), np.int8)
        for i in range(1, t):
            x = best[:, :, None] + m
            back[:, i] = x.argmax(1)
            best = x.max(1) + e[:, i]
        path = np.empty((n, t), np.int8)
        path[:, -1] = best.argmax(1)
        rows = np.arange(n)
        for i in range(t - 1, 0, -1):
            path[:, i - 1] = back[rows, i, path[:, i]]
        gain = np.take_along_axis(e, path[..., None].astype(np.int64), 2)[..., 0] - e[..., 0]
        gain[:, 1:] += m[path[:, :-1], path[:, 1:]] - m[0, 0]
        return path, gain


def _made_up(rng: np.random.Generator, kind: str) -> str:
    """A span of the kind as the patterns know it."""
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k))
    if kind == "email":
        return word(int(rng.integers(2, 9))) + str(rng.choice(["", ".", "_", "-"])) + (num(2) if rng.random() < 0.5 else word(3)) + "@" + word(int(rng.integers(3, 8))) + str(rng.choice(["", "7"])) + "." + str(rng.choice(["com", "org", "example.com", "net"]))
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        d = str(rng.integers(3, 7)) + num(14)
        d += next(c for c in "0123456789" if _luhn(d + c))
        return str(rng.choice(["", " ", "-"])).join(d[i : i + 4] for i in range(0, 16, 4))
    a, b, c = num(3), num(3), num(4)
    return str(rng.choice([f"+1 ({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}"]))


def rewritten(rng: np.random.Generator, kind: str, span: str) -> str:
    """The same data in a way of writing that no fixed pattern matches."""
    if kind == "email":
        user, host = span.split("@", 1)
        at, dot = [(" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" AT ", " DOT "), (" @ ", " . ")][int(rng.integers(6))]
        return user + at + (host.replace(".", dot) if dot != "." else host + " dot")
    digits = re.findall("[0-9]+", span)
    if kind == "ip":
        return str(rng.choice(["[.]", " . ", "(.)", " dot "])).join(digits)
    whole = "".join(digits)
    if kind == "card":
        return str(rng.choice([".", "/", "_", " . "])).join(whole[i : i + 4] for i in range(0, len(whole), 4))
    d = whole[-10:].rjust(10, "5")
    return str(rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"001 {d[:3]} {d[3:6]} {d[6:]}", f"({d[:3]}) {d[3:6]} {d[6:]}"]))


def _planted(rng: np.random.Generator) -> tuple[str, str]:
    """(kind, text) of one made-up span, or ("", text) of something with digits that is none."""
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k))
    pick = int(rng.integers(0, 11))
    if pick < 8:
        span = _made_up(rng, KINDS[pick // 2])
        return KINDS[pick // 2], rewritten(rng, KINDS[pick // 2], span) if rng.random() < 0.5 else span
    return "", str(rng.choice([num(int(rng.integers(1, 8))), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"${num(3)}.{num(2)}", f"{num(2)}%", "@" + word(6), f"at the dot {word(4)}", f"{num(4)}-{num(4)}", f"{num(3)}.{num(3)}.{num(3)}", hashlib.md5(num(5).encode()).hexdigest()]))


def masked(text: str) -> str:
    """The text without what may be personal data: it would count as none in training. Short numbers stay."""
    return _OWN.sub(" ", text)


def labelled(rng: np.random.Generator, text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A stretch of the corpus with the spans that the patterns find in it, some of them rewritten."""
    out, marks, upto = "", [], 0
    for lo, hi, kind in base_spans(text):
        if lo < upto:
            continue
        span = text[lo:hi]
        out += text[upto:lo]
        if rng.random() < 0.5:
            span = rewritten(rng, kind, span)
        marks.append((kind, len(out), len(out) + len(span)))
        out, upto = out + span, hi
    return out + text[upto:], marks


@lru_cache(maxsize=4)
def trained(plain: tuple[str, ...], own: tuple[str, ...] = ()) -> Tagger:
    """A tagger from spans that the patterns find in the texts of `own`, and from spans planted into those of `plain` (into plain words, if
    there are none), whose own spans are masked."""
    rng = np.random.default_rng(99)
    clean = [c for c in map(masked, plain) if c.strip()] or ["the report was sent to the office and the reply came in the evening. "]
    codes, tags = np.empty((EXAMPLES, SPAN), np.int64), np.zeros((EXAMPLES, SPAN), np.int64)
    for i in range(EXAMPLES):
        if own and i % 3 == 0:
            text, marks = labelled(rng, own[int(rng.integers(len(own)))])
            if marks:  # a window that holds one of them
                at = marks[int(rng.integers(len(marks)))]
                cut = max(0, min(at[1] - int(rng.integers(0, SPAN // 2)), len(text) - SPAN))
                text, marks = text[cut:], [(k, lo - cut, hi - cut) for k, lo, hi in marks if hi > cut]
        else:
            base = clean[int(rng.integers(len(clean)))]
            at = int(rng.integers(0, len(base)))
            text, marks = base[at : at + int(rng.integers(0, 40))], []
            while len(text) < SPAN:
                kind, span = _planted(rng)
                text += str(rng.choice([" ", " ", "\n", " (", ": "])) if text and text[-1] not in " \n" else ""
                if kind:
                    marks.append((kind, len(text), len(text) + len(span)))
                at = int(rng.integers(0, len(base)))
                text += span + str(rng.choice([" ", " ", ", ", ". ", "\n"])) + base[at : at + int(rng.integers(5, 40))]
        codes[i] = _codes(text, SPAN)
        for kind, lo, hi in marks:
            k = 1 + 2 * KINDS.index(kind)
            tags[i, max(0, lo) : hi] = k + 1
            if 0 <= lo < SPAN:
                tags[i, lo] = k
    # a span cut by a window's start begins there
    first = tags[:, 0]
    tags[:, 0] = np.where((first > 0) & (first % 2 == 0), first - 1, first)
    tagger = Tagger(rng)
    tagger.train(codes, tags, rng)
    return tagger


def _plausible(kind: str, text: str) -> bool:
    """What any span of a kind must meet, however it is written."""
    digits = [c for c in text if c in "0123456789"]
    if kind == "email":
        return "@" in text[1:-1] or re.search(r"\w[\W_]+at[\W_]+\w.*\bdot\b", text, re.I) is not None
    if kind == "ip":
        parts = re.findall("[0-9]{1,9}", text)
        return len(parts) == 4 and all(int(p) < 256 for p in parts)
    return _luhn("".join(digits)) if kind == "card" and 14 <= len(digits) <= 19 else kind == "phone" and 10 <= len(digits) <= 15


def _windows(text: str) -> list[int]:
    """Starts of the windows that cover every hint, on a grid of half a window; each hint lies in two of them."""
    half, seen = SPAN // 2, set()
    for m in _HINT.finditer(text):
        k = m.start() // half
        seen.add(k)
        if k:
            seen.add(k - 1)
    return sorted(k * half for k in seen)


def _hopeless(kind: str, text: str) -> bool:
    """No span of the kind can hold this piece: it has too many digits already."""
    digits = sum(c in "0123456789" for c in text)
    return kind == "card" and digits > 19 or kind == "phone" and digits > 15


def _around(text: str, lo: int, hi: int, least: int) -> tuple[int, int]:
    """(width, start) of a window with half a SPAN at least to either side of [lo, hi); widths are SPAN times powers of 2."""
    width = SPAN
    while width < max(least, hi - lo + SPAN):
        width *= 2
    return width, max(0, min((lo + hi - width) // 2, len(text) - width))


class _Reach:
    """Intervals, to ask how far those reach that start before a place."""

    def __init__(self, intervals: list[tuple[int, int]]):
        some = sorted(intervals)
        self.starts = [a for a, _ in some]
        self.ends = list(accumulate((b for _, b in some), max))

    def before(self, place: int) -> int:
        k = bisect_left(self.starts, place)
        return self.ends[k - 1] if k else -1


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """Per text the tagger's spans, reconciled: of overlapping ones those of best total score."""
    where = [(i, s, 0, len(t)) for i, t in enumerate(texts) for s in _windows(t)]
    found: list[list] = [[] for _ in texts]

    def read(where: list[tuple[int, int, int, int]], width: int) -> tuple[dict, list]:
        """Take the spans of windows (text, start, and the stretch whose spans count). Runs seen whole, by text, and runs cut by a window's edge."""
        whole, cuts, many = {}, [], max(1, 512 * SPAN // width)
        for at in range(0, len(where), many):
            some = where[at : at + many]
            path, gain = tagger.decode(np.stack([_codes(texts[i][s : s + width], width) for i, s, _, _ in some]))
            for r in np.flatnonzero((path > 0).any(1)):
                i, s, least, most = some[r]
                row, end = path[r], min(width, len(texts[i]) - s)
                p = 0
                while p < end:
                    if row[p] == 0:
                        p += 1
                        continue
                    q = p + 1
                    kind = (row[p] - 1) // 2
                    while q < end and row[q] == 2 + 2 * kind:
                        q += 1
                    lo, hi = s + p, s + q
                    if lo < most and hi > least:
                        if p == 0 and s > 0 or q == width and hi < len(texts[i]):
                            if not _hopeless(KINDS[kind], texts[i][lo:hi]):
                                cuts.append((i, lo, hi, width))
                        else:
                            whole.setdefault(i, []).append((lo, hi))
                            score = float(gain[r, p:q].mean())
                            if score >= MARGIN and q - p >= SHORTEST and _plausible(KINDS[kind], texts[i][lo:hi]):
                                found[i].append((lo, hi, KINDS[kind], score * (q - p)))
                    p = q
        return whole, cuts

    whole, cuts = read(where, SPAN)
    # cut runs that no window sees whole; those that overlap are one
    todo: list[list[int]] = []
    seen = {i: _Reach(runs) for i, runs in whole.items()}
    for i, lo, hi, width in sorted(cuts):
        if i in seen and seen[i].before(lo + 1) >= hi:
            continue
        if todo and todo[-1][0] == i and lo < todo[-1][2]:
            todo[-1][2] = max(hi, todo[-1][2])
        else:
            todo.append([i, lo, hi, width])
    while todo:
        by_width: dict[int, set] = {}
        for i, lo, hi, width in todo:
            wider, start = _around(texts[i], lo, hi, 2 * width)
            by_width.setdefault(wider, set()).add((i, start, lo, hi))
        todo = [c for width, windows in sorted(by_width.items()) for c in read(sorted(windows), width)[1]]
    out = []
    for spans in found:
        spans = sorted(set(spans), key=lambda x: x[1])
        ends = [x[1] for x in spans]
        best: list[tuple[float, tuple]] = [(0.0, ())]
        for j, (lo, hi, kind, score) in enumerate(spans):
            k = bisect_right(ends, lo, 0, j)
            take = (best[k][0] + score, (best[k][1], (lo, hi, kind)))
            best.append(max(best[j], take, key=lambda x: x[0]))
        chain, chosen = best[-1][1], []
        while chain:
            chain, last = chain
            chosen.append(last)
        out.append(chosen[::-1])
    return out


def find_spans(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """Per text: the fixed patterns' spans, and all spans (those, and tagged ones that overlap none of them)."""
    hinted = [i for i, t in enumerate(texts) if _HINT.search(t)]
    base = {i: base_spans(texts[i]) for i in hinted}
    extra = dict(zip(hinted, tagged_spans([texts[i] for i in hinted], tagger), strict=True))
    out = []
    for i in range(len(texts)):
        own = base.get(i, [])
        more = []
        if extra.get(i):
            reach = _Reach([s[:2] for s in own])
            more = [s for s in extra[i] if reach.before(s[1]) <= s[0]]
        out.append((own, sorted([*own, *more], key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if more else own))
    return out


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def contexts(docs: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The stretches to train on: from anywhere in SAMPLE texts of least hash, and around likely personal data of SAMPLE texts that hold some.

    A threshold goes before the sort (least_hashes), so that what reaches the driver does not grow with rows or tasks.
    """
    rows = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    total, h = rows.count(), F.xxhash64("doc_id", "text")
    room = F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1
    anywhere = F.array(*[F.substring("text", F.pmod(F.xxhash64(h, F.lit(k)), room).cast("int") + 1, F.lit(STRETCH)) for k in range(STRETCHES)])
    around = F.array(F.substring("text", F.greatest(F.regexp_instr("text", F.lit(_LIKELY)) - STRETCH // 2, F.lit(1)), F.lit(STRETCH)))
    out = []
    likely = rows.where(F.col("text").rlike(_LIKELY))
    for some, parts, number in ((rows, anywhere, total), (likely, around, likely.count())):
        found = least_hashes(some, SAMPLE, "doc_id", "text", total=number).select(parts.alias("parts")).collect()
        out.append(tuple(dict.fromkeys(p for r in found for p in r["parts"])))
    return out[0], out[1]


def _tagger(docs: DataFrame) -> Tagger:
    return trained(*contexts(docs))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the fixed patterns' spans), spans (all spans).

    The fixed patterns read every text whole. The tagger reads windows of whole texts around digits, @ and the word dot (_HINT), for every way of writing that it
    learns has one of these; what it finds counts from SHORTEST characters on, and only if it passes its kind's own test (digits, Luhn, parts up to 255).
    Null and empty texts have no spans; texts of any length are read whole; an empty table gives no rows. Rows that repeat a doc_id are read each by
    itself. Offsets are code points, ends exclusive. Only text is read; other columns play no part.
    """
    tagger = _tagger(docs)
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, raw = columns(batch, "doc_id", "text")
            for at in range(0, len(ids), 1000):
                found = find_spans([t or "" for t in raw[at : at + 1000]], tagger)
                counts = [[sum(s[2] == k for s in own) for own, _ in found] for k in KINDS]
                yield rows_out(out, ids[at : at + 1000], *counts, [hashlib.sha256(_joined(own).encode()).hexdigest() for own, _ in found], [_joined(every) for _, every in found])

    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, such as [EMAIL]; n_chars follows. Other columns stay.

    Spans are those of find_personal_data(). Null and empty texts stay as they are, repeated rows are read each by itself, texts of any length
    whole; an empty table stays empty."""
    tagger = _tagger(docs)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            (raw,) = columns(batch, "text")
            done: list = []
            for at in range(0, len(raw), 1000):
                some = raw[at : at + 1000]
                for t, (_, spans) in zip(some, find_spans([t or "" for t in some], tagger), strict=True):
                    parts, upto = [], 0
                    for lo, hi, kind in spans:
                        if hi > upto:
                            parts += [t[upto : max(lo, upto)], f"[{kind.upper()}]" if lo >= upto else ""]
                            upto = hi
                    done.append("".join([*parts, t[upto:]]) if spans else t)
            yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(done, batch.schema.field("text").type))

    cleaned = docs.mapInArrow(run, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
