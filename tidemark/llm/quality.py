"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass computes the statistics of every whole text. Class means and covariances come from sums over all labelled
training rows, made in Spark; the covariances are shrunk towards the pooled one and its diagonal. A score is the
logistic of the difference of the two log densities, each from a Mahalanobis distance by a cached Cholesky factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import Batches, by_sorting, columns, rows_out, stage, texts

THRESHOLD = 0.3
#: Parts of the pooled covariance and of its diagonal in a class covariance.
POOLED, DIAGONAL = 0.2, 0.05
FOLDS = 5
#: Log density differences are divided by this: the statistics are far from independent.
TEMPER = 4.0
_GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*@^~=+<>/\\_", b"|", b"!?", b".", b",;:", b"'\"()[]{}-", b"\n", bytes(range(128, 256)))
_TABLE = np.stack([np.isin(np.arange(256), np.frombuffer(g, np.uint8)) for g in _GROUPS], 1).astype(float)
D = len(_GROUPS) + 9
_STATS = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])


def statistics(text: bytes | None) -> list[float]:
    """D numbers about a text; counts become logs of shares, sizes become logs."""
    text = text or b""
    words = text.split()
    n, k = len(text), len(words)
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE / max(1, n)
    distinct = set(words)
    size = np.fromiter(map(len, words), float, k) if k else np.zeros(1)
    lines = text.split(b"\n")
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(1 for w in words if w[-1:].isalpha() or w[-1] > 127)
    return [
        *np.log(share + 0.002).tolist(),
        np.log1p(n),
        np.log1p(k),
        float(size.mean()),
        float(np.log1p(size.std())),
        len(distinct) / max(1, k),
        pairs / max(1, k - 1) if k > 1 else 1.0,
        len(set(lines)) / len(lines),
        float(np.log1p(k / len(lines))),
        ends / max(1, k),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, raw = columns(batch, "doc_id", "text")
            for at in range(0, len(ids), 500):
                yield rows_out(_STATS, ids[at : at + 500], [statistics(t) for t in raw[at : at + 500]])

    return texts(docs).mapInArrow(run, "doc_id long, stats array<double>")


def _moments(batches: Batches) -> Batches:
    out = pa.schema([("quality", pa.int32()), ("sums", pa.list_(pa.float64()))])
    sums = {0: np.zeros(1 + D + D * D), 1: np.zeros(1 + D + D * D)}
    for batch in batches:
        q, stats = columns(batch, "quality", "stats")
        if q:
            x, q = np.array(stats), np.array(q)
            for c in sums:
                y = x[q == c]
                sums[c] += np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
    yield rows_out(out, list(sums), [s.tolist() for s in sums.values()])


class Discriminant:
    """Means, inverse Cholesky factors and log constants of both classes; None where a class has no rows."""

    def __init__(self, sums: dict[int, np.ndarray]):
        self.classes = None
        counts = {c: s[0] for c, s in sums.items()}
        if min((counts.get(0, 0), counts.get(1, 0))) < 1:
            return
        mean = {c: s[1 : 1 + D] / s[0] for c, s in sums.items()}
        scatter = {c: s[1 + D :].reshape(D, D) - s[0] * np.outer(mean[c], mean[c]) for c, s in sums.items()}
        pooled = sum(scatter.values()) / sum(counts.values())
        base = np.diag(np.diag(pooled) + 1e-6)
        self.classes = []
        for c in (0, 1):
            own = POOLED + (1 - POOLED) * D / (counts[c] + D)  # few rows: more of the pooled one
            cov = (1 - DIAGONAL) * ((1 - own) * scatter[c] / counts[c] + own * pooled) + DIAGONAL * base
            factor = np.linalg.inv(np.linalg.cholesky(cov))
            self.classes.append((mean[c], factor, np.log(np.diag(factor)).sum() + np.log(counts[c] / sum(counts.values()))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), 0.5)
        low, high = (const - 0.5 * (((x - mean) @ factor.T) ** 2).sum(1) for mean, factor, const in self.classes)
        return 1 / (1 + np.exp(-np.clip((high - low) / TEMPER, -40, 40)))


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """From the labelled rows whose fold isn't 0. Labels other than 0 and 1 are left out; only sums reach the driver."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = stats.join(by_sorting(known.where(fold() != 0)), "doc_id").select("quality", "stats").mapInArrow(_moments, "quality int, sums array<double>")
    sums = rows.select("quality", F.posexplode("sums")).groupBy("quality", "pos").agg(F.sum("col").alias("v")).collect()
    out = {c: np.zeros(1 + D + D * D) for c in (0, 1)}
    for r in sums:
        out[r["quality"]][r["pos"]] = r["v"]
    return Discriminant(out)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted.

    Null and empty texts have the statistics of the empty text. Without training rows of both classes every score is 0.5. A
    null doc_id is never held out. Rows that repeat a doc_id are scored each by itself (and join a label each). Only the text
    is scored, whole and of any length: other columns play no part. An empty table gives no rows.
    """
    stats = stage(document_statistics(docs))
    model = fit(stats, labels)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, x = columns(batch, "doc_id", "stats")
            if ids:
                yield rows_out(out, ids, model.score(np.array(x)))

    held = F.coalesce(fold() == 0, F.lit(False))
    return stats.mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs, all columns, whose whole text is predicted 1. Fitted as classify() is.

    Null and empty texts are scored as the empty text, repeated rows each by itself, texts of any length whole; an empty table stays empty.
    The statistics are computed once: they are written beside the rows, in a column of a name that docs does not have.
    """
    name = "stats"
    while name in docs.columns:
        name += "_"
    kept = docs.columns
    out = StructType([*docs.schema, StructField(name, ArrayType(DoubleType()))])

    def measure(batches: Batches) -> Batches:
        for batch in batches:
            (raw,) = columns(batch, "text")
            yield batch.append_column(name, pa.array([statistics(t.encode() if t else None) for t in raw], pa.list_(pa.float64())))

    rows = stage(docs.mapInArrow(measure, out))
    model = fit(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("stats")), labels)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            (x,) = columns(batch, name)
            if x:
                yield batch.filter(pa.array(model.score(np.array(x)) >= THRESHOLD)).select(kept)

    return rows.mapInArrow(run, docs.schema)
