"""Periodic run detection: seed and extend along the diagonals of a document compared with itself.

A run of period q and length at least max(6, 4 q) agrees with itself, q words on, over 3 q words (5 for q = 1). Lags are
therefore taken in classes [2^j, 2^(j+1)), each with an index of the k-grams that every run of the class must hold: k = 3 * 2^j
(5 for lag 1). Since k is at least q, the next occurrence of such a gram inside a run of smallest period q lies exactly
q words on (periods r and q - r of the gram would make gcd(r, q - r) a period of the run), so pairs of consecutive
occurrences are all that is needed: at most one pair a word and class, however often a gram occurs. Each pair is extended to
both sides along its lag, unless the table of the furthest word covered on that lag has it already.
Documents are independent rows: no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Batches, columns, rows_out, texts

#: A run has at least LEAST words and COPIES periods.
LEAST, COPIES = 6, 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _longer(name: np.ndarray, shift: int) -> np.ndarray | None:
    """Exact names of grams that are `shift` words longer than those named; -1 where a gram occurs once. None: none occurs twice."""
    m = len(name) - shift
    if m <= 1:
        return None
    a, b = name[:m], name[shift:]
    at = np.flatnonzero((a >= 0) & (b >= 0))
    if len(at) < 2:
        return None
    _, inverse, counts = np.unique(a[at] * (b.max() + 1) + b[at], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return None
    out = np.full(m, -1, np.int64)
    out[at[again]] = inverse[again]
    return out


def _seeds(name: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, position) of each pair of consecutive occurrences whose lag is in [low, high), by lag, then position."""
    at = np.flatnonzero(name >= 0)
    at = at[np.argsort(name[at], kind="stable")]
    lag = np.diff(at)
    good = (name[at[1:]] == name[at[:-1]]) & (lag >= low) & (lag < high)
    lag, at = lag[good], at[:-1][good]
    order = np.lexsort((at, lag))
    return lag[order], at[order]


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many entries agree before the first that doesn't; looks at chunks of growing size."""
    done, step, n = 0, 64, min(len(x), len(y))
    while done < n:
        differ = np.flatnonzero(x[done : done + step] != y[done : done + step][: len(x[done : done + step])])
        if len(differ):
            return done + int(differ[0])
        done, step = min(n, done + step), 2 * step
    return done


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of a sequence of word numbers (0 or above), by start, then period."""
    n, found = len(ids), []
    if n < LEAST:
        return found
    three = ids.astype(np.int64)
    three = np.where(np.bincount(three)[three] > 1, three, -1)
    for _ in range(2):
        three = _longer(three, 1)
        if three is None:
            return found
    reach: dict[int, int] = {}  # by lag: the furthest word that an extension has covered

    def extend(name: np.ndarray, k: int, low: int, high: int) -> None:
        lags, at = _seeds(name, low, high)
        edges = np.flatnonzero(np.diff(lags, prepend=-1, append=-1))
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            q, own = int(lags[first]), at[first:last]
            t = 0
            while t < len(own):
                i = int(own[t])
                if i >= reach.get(q, 0):
                    end = i + k + _agreeing(ids[i + k : n - q], ids[i + k + q :])
                    start = i - _agreeing(ids[:i][::-1], ids[q : i + q][::-1])
                    reach[q] = end
                    if end - start + q >= max(LEAST, COPIES * q):
                        found.append((start, end - start + q, q))
                t = max(t + 1, int(np.searchsorted(own, reach[q])))

    name = _longer(three, 2)
    if name is not None:
        extend(name, 5, 1, 2)
    name, k, low = _longer(three, 3), 6, 2
    while name is not None and COPIES * low <= n:
        extend(name, k, low, 2 * low)
        name, k, low = _longer(name, k), 2 * k, 2 * low
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period alone."""
    covered = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        covered[start + q] += 1
        covered[start + length] -= 1
    return np.cumsum(covered[:n]) == 0


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed (text of the words that stay).

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Texts are read whole whatever their length,
    in memory that grows with the one text. Repeated rows are read each by itself, a null doc_id stays null, an empty
    table gives no rows, other columns play no part.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, raw = columns(batch, "doc_id", "text")
            for at in range(0, len(ids), 500):
                out = ([], [], [])
                for text in raw[at : at + 500]:
                    words = (text or b"").split()
                    number: dict[bytes, int] = {}
                    found = runs_of(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))) if len(words) >= LEAST else []
                    if found:
                        stays = kept_words(len(words), found)
                        words = [words[i] for i in np.flatnonzero(stays)]
                    n = len(words) if not found else len(stays)
                    for column, value in zip(out, (n, [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], b" ".join(words)), strict=True):
                        column.append(value)
                yield rows_out(_OUT, ids[at : at + 500], *out)

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """docs with the loops that the query's contract plants into a tenth of the texts: from word a on, the first p words again and again."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    with_words = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))

    def again(i: Column) -> Column:
        return F.get("words", F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i).cast("int"))

    some = F.col("words").isNotNull() & (n > 0)
    placed = with_words.withColumn("a", F.when(some, a)).withColumn("p", F.when(some, p))
    text = F.when(F.col("a").isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), again), " ")).otherwise(F.col("text"))
    return placed.select("doc_id", text.alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from what find_runs() gives: the run of most copies (ties: the first, then the shorter period) and digests."""
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
