"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features are densities of two lexicons, their nearness to words of address, capitals, punctuation and obfuscation. One lexicon is the
fixed list below. The other is learned: words and word stems that tell toxic training texts from others, each with its
log odds; a training text is measured with its own counts taken out, so that trees see in training what they will meet later.
Words are counted by Spark over the training sample; the trees are boosted in numpy over binned features of the sample, and
calibrated on predictions for texts that the trees predicting them had not seen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, columns, least_hashes, rows_out, texts

THRESHOLD = 0.5
FOLDS = 5
#: At most so many labelled documents (those of least hash) train the model.
FIT_ROWS = 12_000
#: At most so many learned stems, of greatest evidence; a stem counts from STRONG on as strong, from WEAK on as weak.
STEMS, WEAK, STRONG = 8_192, 1.2, 2.5
STEM_SIZES = (4, 6)
#: A word of address so many words away from a lexicon word counts as near.
NEAR = 5
TREES, DEPTH, RATE, BINS, RIDGE, PARTS = 100, 4, 0.12, 48, 2.0, 3

# Words of insult and contempt, and words that address somebody, in the corpus's languages.
INSULTS = frozenset(
    "bastard clown coward creep cretin disgusting dumb fool freak garbage idiot imbecile jerk loser moron pathetic pig scum stupid trash ugly vermin worthless "
    "dummkopf abschaum arschloch blödmann idioten idiotisch trottel versager wertlos "
    "abruti connard crétin débile imbécile minable ordure salaud "
    "basura cabrón escoria estúpido estúpida idiota imbécil inútil payaso patético".split()
)
ADDRESS = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu toi te ton ta vous votre tú ti usted ustedes vosotros vuestro".split())

_WORD = re.compile(r"[^\W\d_]+")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "*": None, ".": None, "-": None, "_": None})
_INNER = re.compile(r"[^\W_][*@$!|.\-_0-9]+[^\W_]")
_PUNCTUATION = np.frombuffer(b".,;:!?\"'()-", np.uint8)
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
NAMES = (
    "words", "insult_count", "insult_density", "insult_kinds", "strong_count", "strong_density", "strong_kinds", "weak_count", "weak_density", "weak_kinds", "evidence", "most",
    "address_density", "near_count", "near_density", "capitals", "shouted", "exclamations", "questions", "punctuation", "repeated_marks", "inner_digits", "inner_marks", "stretched", "hidden",
)
D = len(NAMES)
_COUNTS = pa.schema([("stem", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def stems(word: str) -> list[str]:
    """A word, and its beginnings (marked) where it is longer."""
    return [word, *(word[:k] + "*" for k in STEM_SIZES if len(word) > k)]


_INSULT, _STRONG, _WEAK, _ADDRESS, _STRETCH = 1, 2, 4, 8, 16
_SHOUT, _DIGITS, _MARKS, _HIDDEN = 1, 2, 4, 8


class _Memory(dict):
    """What a function says of a word or token, remembered for a bounded number of them."""

    LIMIT = 300_000

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[key] = self.of(key)
        return value


class Lexicon:
    """Learned stems with the numbers of toxic and clean training texts that hold them, and these numbers over all."""

    def __init__(self, counts: dict[str, tuple[int, int]] | None = None, toxic: int = 0, clean: int = 0):
        self.counts, self.toxic, self.clean = counts or {}, toxic, clean
        self._memories: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memories": {}}

    def weight(self, t: int, c: int, own: int | None) -> float:
        """Log odds of t toxic and c clean texts, without the text measured if its own label is given."""
        return float(np.log((t - (own == 1) + 0.5) / (self.toxic - (own == 1) + 1)) - np.log((c - (own == 0) + 0.5) / (self.clean - (own == 0) + 1)))

    def best(self, word: str, own: int | None = None) -> float:
        """Greatest log odds of the word's stems, 0 without any; the text measured is taken out of the counts if its label is given."""
        return max([0.0, *(self.weight(*self.counts[s], own) for s in stems(word) if s in self.counts)])

    def _of_word(self, word: str, own: int | None) -> int:
        weight = self.best(word, own)
        return (word in INSULTS) * _INSULT | (weight >= STRONG) * _STRONG | (WEAK <= weight < STRONG) * _WEAK | (word in ADDRESS) * _ADDRESS | (_STRETCHED.search(word) is not None) * _STRETCH

    def _of_token(self, token: str, own: int | None) -> int:
        what = _SHOUT if len(token) > 2 and token.isupper() else 0
        if not token.isalpha() and _INNER.search(token):
            what |= _DIGITS if any(c.isdigit() for c in token) else _MARKS
            plain = token.lower().strip(".,;:!?\"'()").translate(_PLAIN)
            what |= _HIDDEN if plain in INSULTS or self.best(plain, own) >= STRONG else 0
        return what

    def memories(self, own: int | None) -> tuple[_Memory, _Memory]:
        """What words and tokens are; one of each a label, for a worker's life."""
        if own not in self._memories:
            self._memories[own] = _Memory(lambda w: self._of_word(w, own)), _Memory(lambda t: self._of_token(t, own))
        return self._memories[own]


def features(text: str | None, lexicon: Lexicon, own: int | None = None) -> list[float]:
    """D numbers about a text. Counts are logs, densities are logs of parts in a thousand words. Capitals are A to Z."""
    text = text or ""
    of_word, of_token = lexicon.memories(own)
    words, tokens = _WORD.findall(text.lower()), text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    what = np.fromiter(map(of_word.__getitem__, words), np.uint8, len(words))
    bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    met: dict[int, list[str]] = {k: [words[i] for i in np.flatnonzero(what & k)] for k in (_INSULT, _STRONG, _WEAK)}
    insults, strong, weak = met.values()
    address, hits = np.flatnonzero(what & _ADDRESS), np.flatnonzero(what & (_INSULT | _STRONG))
    near = 0
    if len(address) and len(hits):
        place = np.searchsorted(address, hits)
        near = int(((np.abs(hits - address[np.maximum(place - 1, 0)]) <= NEAR) | (np.abs(address[np.minimum(place, len(address) - 1)] - hits) <= NEAR)).sum())
    kind = np.fromiter(map(of_token.__getitem__, tokens), np.uint8, len(tokens))
    shouted, inner, marks, hidden = (int(np.count_nonzero(kind & k)) for k in (_SHOUT, _DIGITS, _MARKS, _HIDDEN))
    letters = sum(map(len, words)) or 1
    weights = [lexicon.best(w, own) for w in {*strong, *weak}]

    def per(k: int) -> float:
        return float(np.log1p(1000 * k / n))

    return [
        float(np.log1p(len(words))),
        float(np.log1p(len(insults))), per(len(insults)), float(len(set(insults))),
        float(np.log1p(len(strong))), per(len(strong)), float(np.log1p(len(set(strong)))),
        float(np.log1p(len(weak))), per(len(weak)), float(np.log1p(len(set(weak)))),
        float(sum(sorted(weights))), max(weights, default=0.0),
        per(len(address)), float(np.log1p(near)), per(near),
        float(bytes_[65:91].sum()) / letters, per(shouted),
        float(bytes_[33]) / chars, float(bytes_[63]) / chars, float(bytes_[_PUNCTUATION].sum()) / chars,
        per(sum(text.count(c) for c in ("!!", "??", "##", "$$", "%%"))),
        per(inner), per(marks), per(int(np.count_nonzero(what & _STRETCH))), float(np.log1p(hidden)),
    ]


@dataclass
class Trees:
    """Boosted trees over binned features: node k of a tree splits its rows on feature[k] at bin[k] into 2k+1 and 2k+2; leaf holds the values below."""

    edges: list[np.ndarray]
    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, row = self.binned(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[row, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss; every level takes each node's best cut over all bins of all features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(rate / (1 - rate))), *(np.zeros((TREES, m), t) for m, t in ((2**DEPTH - 1, np.int64), (2**DEPTH - 1, np.int64), (2**DEPTH, float))))
    b = model.binned(x)
    d, size = b.shape[1], BINS + 1
    flat = b + size * np.arange(d)
    margin = np.full(len(y), model.start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)  # number within the level
        for level in range(DEPTH):
            at = (flat + node[:, None] * (d * size)).ravel()
            sums = [np.bincount(at, np.repeat(v, d), (1 << level) * d * size).reshape(-1, d, size).cumsum(2) for v in (g, h)]
            (gl, hl), (ga, ha) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE)
            best = gain.reshape(len(gain), -1).argmax(1)
            first = (1 << level) - 1
            model.feature[t, first : first + len(best)], model.cut[t, first : first + len(best)] = best // size, best % size
            node = 2 * node + (b[np.arange(len(y)), best[node] // size] > (best % size)[node])
        count = 1 << DEPTH
        model.leaf[t] = -RATE * np.bincount(node, g, count) / (np.bincount(node, h, count) + RIDGE)
        margin += model.leaf[t][node]
    return model


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising function nearest to y (pool adjacent violators): mean margin and smoothed mean label of each pool."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # rows, sum of y, sum of x
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([1.0, float(b), float(a)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    n, s, at = np.array(pools).T
    return at / n, np.maximum.accumulate((s + 0.01) / (n + 0.02))


@dataclass
class Toxicity:
    """A fitted model; without texts of both classes in training it is their rate (0 without any)."""

    lexicon: Lexicon
    rate: float
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def score(self, raw: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(raw), self.rate)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in raw]).reshape(-1, D))
        inside = np.interp(margin, *self.knots)
        # beyond the pools' ends, and inside a pool, a trace of the margin keeps the order
        return np.clip(inside * 0.999 + 0.001 / (1 + np.exp(-margin)), 0, 1)


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, text: at most FIT_ROWS labelled rows whose fold is not 0, one text a doc_id (the least). Labels that contradict one another are left out."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(fold() != 0).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    some = [(r["doc_id"], r["toxic"]) for r in least_hashes(known, FIT_ROWS, "doc_id").collect()]
    sample = F.broadcast(docs.sparkSession.createDataFrame(some, "doc_id long, toxic int"))  # FIT_ROWS rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _stem_counts(batches: Batches) -> Batches:
    counts: dict[str, list[int]] = {}

    def flush():
        got = rows_out(_COUNTS, list(counts), [v[1] for v in counts.values()], [v[0] for v in counts.values()])
        counts.clear()
        return got

    for batch in batches:
        for text, toxic in zip(*columns(batch, "text", "toxic"), strict=True):
            for s in {s for w in set(_WORD.findall((text or "").lower())) for s in stems(w)}:
                counts.setdefault(s, [0, 0])[toxic] += 1
            if len(counts) > 100_000:
                yield flush()
    yield flush()


def learned_lexicon(rows: DataFrame) -> Lexicon:
    """From doc_id, toxic, text. The STEMS stems of greatest evidence (toxic texts times log odds) reach the driver."""
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = rows.select("text", "toxic").mapInArrow(_stem_counts, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    best = counts.where("t >= 2").withColumn("w", odds).where(F.col("w") >= WEAK).orderBy((F.col("t") * F.col("w")).desc(), "stem").limit(STEMS)
    return Lexicon({r["stem"]: (r["t"], r["c"]) for r in best.collect()}, toxic, clean)


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """From the bounded sample that training_texts() gives. Its features (D doubles a row) are computed by Spark and boosted on the driver."""
    rows = training_texts(docs, labels).persist()
    try:
        lexicon = learned_lexicon(rows)
        out = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

        def measure(batches: Batches) -> Batches:
            for batch in batches:
                ids, toxic, raw = columns(batch, "doc_id", "toxic", "text")
                yield rows_out(out, ids, toxic, [features(t, lexicon, own) for t, own in zip(raw, toxic, strict=True)])

        got = sorted(tuple(r) for r in rows.mapInArrow(measure, "doc_id long, toxic int, x array<double>").collect())
    finally:
        rows.unpersist()
    y = np.array([r[1] for r in got], float)
    if len(set(y)) < 2:
        return Toxicity(lexicon, float(y.mean()) if len(y) else 0.0)
    x = np.array([r[2] for r in got])
    part = np.arange(len(y)) % PARTS
    margins = np.zeros(len(y))
    for k in range(PARTS):
        rest = part != k
        margins[~rest] = boost(x[rest], y[rest]).margin(x[~rest])
    return Toxicity(lexicon, float(y.mean()), boost(x, y), isotonic(margins, y))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted.

    Null and empty texts have the features of the empty text. Without training rows of both classes every score is the rate of
    toxic ones (0 without training rows). A null doc_id is never held out. Rows that repeat a doc_id are scored each by
    itself. Only the text is scored, whole and of any length: other columns play no part. An empty table gives no rows.
    """
    model = fit(docs, labels)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, raw = columns(batch, "doc_id", "text")
            for at in range(0, len(ids), 500):
                part = [None if t is None else t.decode("utf-8", "replace") for t in raw[at : at + 500]]
                yield rows_out(_SCORES, ids[at : at + 500], model.score(part).tolist())

    held = F.coalesce(fold() == 0, F.lit(False))
    return texts(docs).mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
