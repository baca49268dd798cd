"""Embedding whitening: float32 eigenvectors of a distributed covariance, refined by matrix products in higher precision.

Spark sums the fixed-point vectors, then the products of the centred ones: whole numbers held in doubles, exact below 2^53
whatever the order of tasks. The covariance is formed from these sums in whole numbers and rounded once. Its float32
eigenvectors X are corrected by the Ogita-Aishima iteration

    R = I - X'X,  S = X'AX,  l_i = S_ii / (1 - R_ii),  E_ij = (S_ij + l_j R_ij) / (l_j - l_i)  or  R_ij / 2 in a cluster,  X <- X + XE

in long doubles (64 bits of mantissa on x86; doubles where the platform has none). Eigenvalues nearer to each other than the
iteration can tell make a cluster: the small symmetric problem in the space of its vectors, shifted by their mean, is
solved by itself and turns them before the iteration goes on.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, rows_out
from .vectors import finite

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Entries beyond this many units count as this many: 1.7e10 in the vector's own scale.
MOST = 1 << 40
#: Eigenvalues up to this part of the greatest, for each dimension, are rounding alone: no component.
RANK = 1e-15
ITERATIONS = 30
_HIGH = np.longdouble
_PART = pa.schema([("part", pa.list_(pa.float64()))])
_OUT = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (may be null), embedding of the vectors that are not null and hold finite entries alone."""
    return vectors.where(finite()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def units(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Rows of floor(SCALE * entry): the fixed-point vectors without OFFSET."""
    flat = batch.column(batch.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(SCALE * flat.astype(np.float64)), -MOST, MOST).astype(np.int64).reshape(-1, dim)


def _summed(vectors: DataFrame, of, size: int) -> list[float]:
    """Sums over all rows of the vector of `size` numbers that of(batch) gives for a batch; one row a task is shuffled."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield rows_out(_PART, [total.tolist()])

    out = [0.0] * size
    for r in vectors.mapInArrow(run, "part array<double>").select(F.posexplode("part")).groupBy("pos").agg(F.sum("col").alias("v")).collect():
        out[r["pos"]] = r["v"]
    return out


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors of the symmetric a (long doubles), falling, from approximate eigenvectors x."""
    d = len(a)
    x, one, norm = x.astype(_HIGH), np.eye(d, dtype=_HIGH), np.sqrt((a * a).sum())
    floor, before = 4 * d * np.finfo(_HIGH).eps * norm, np.inf
    for _ in range(ITERATIONS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        value = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        error = np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())
        if error <= floor or (error >= before / 2 and error <= 1e3 * floor):
            break
        before = error
        gap = value[None, :] - value[:, None]
        near = np.abs(gap) <= 2 * error
        x = x + x @ np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1, gap))
        order = np.argsort(value)
        edges = np.flatnonzero(np.diff(value[order]) > 2 * error) + 1
        for own in np.split(order, edges):
            if len(own) > 1:
                part, mean = x[:, own], value[own].mean()
                small = part.T @ (a @ part) - mean * (part.T @ part)
                unit = max(np.abs(small).max(), np.finfo(float).tiny)
                x[:, own] = part @ np.linalg.eigh(((small + small.T) / (2 * unit)).astype(float))[1].astype(_HIGH)
    x = x + x @ (one - x.T @ x) / 2  # what the turns inside clusters, made in doubles, left
    x = x / np.sqrt((x * x).sum(0))
    value = (x * (a @ x)).sum(0)
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order]


@dataclass
class Whitening:
    """What a transformation needs: dim, n, the centre in whole units, what the mean is above it, vectors (dim x k), eigenvalues, trace."""

    dim: int
    n: int
    centre: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, y: np.ndarray) -> np.ndarray:
        return ((y - self.centre) - self.rest / max(1, self.n)) @ (self.vectors / np.sqrt(self.values))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """From all rows of usable(vectors) that have the most common number of entries (the greater on ties)."""
    rows = usable(vectors)
    met = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim, n = (met[0]["dim"], met[0]["count"]) if met else (0, 0)
    empty = Whitening(dim, n, np.zeros(dim, np.int64), np.zeros(dim), np.zeros((dim, 0)), np.zeros(0), 0.0)
    if not dim:
        return empty
    rows = rows.where(F.size("embedding") == dim)
    total = [int(v) for v in _summed(rows, lambda batch: units(batch, dim).sum(0).astype(float), dim)]
    centre = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)
    rest = [t - n * int(c) for t, c in zip(total, centre, strict=True)]
    upper = np.triu_indices(dim)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        y = (units(batch, dim) - centre).astype(float)
        return (y.T @ y)[upper]

    a = np.zeros((dim, dim), _HIGH)
    for i, j, v in zip(*upper, _summed(rows, products, len(upper[0])), strict=True):
        exact = Fraction(n * int(v) - rest[i] * rest[j], n * n)
        near = float(exact)
        a[i, j] = a[j, i] = _HIGH(near) + _HIGH(float(exact - Fraction(near)))
    trace = np.trace(a)
    if not trace > 0:
        return empty
    values, x = refined(a, np.linalg.eigh(a.astype(np.float32))[1])
    k = min(components, int((values > RANK * dim * values[0]).sum()))
    return Whitening(dim, n, centre, np.array(rest, float), x[:, :k].astype(float), values[:k].astype(float), float(trace))


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, whitened (one double a component) of every row of usable(vectors) with the model's number of entries.

    Repeated rows each count; a null vec_id stays null; other columns play no part; an empty table gives no rows. Vectors of another
    length than the most common one take no part. Where all vectors are equal there are no components (an empty array), and fewer
    than asked for where the vectors span fewer dimensions. deviation is null where no long holds it.
    """
    dim, n = model.dim, model.n
    total = n * model.centre.astype(object) + np.array([int(r) for r in model.rest], object)
    wrapped = np.array([(int(t) + (1 << 63)) % (1 << 64) - (1 << 63) for t in total], np.int64)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = units(batch, dim)
            about = ((n * (y - model.centre).astype(float) - model.rest) ** 2).sum(1)
            with np.errstate(over="ignore"):
                exact = ((np.int64(n) * y - wrapped) ** 2).sum(1)  # modulo 2^64: right wherever the result is below 2^62
            deviation = pa.array(exact, mask=about >= 2.0**62)
            z = pa.array(model.project(y).ravel())
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * model.vectors.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("vec_id")), deviation, pa.ListArray.from_arrays(ends, z)], schema=_OUT)

    return usable(vectors).where(F.size("embedding") == dim).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity (0 without components)."""
    dim, k = model.dim, model.vectors.shape[1]
    if not k:
        return 0.0

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        z = model.project(units(batch, dim))  # centred by the exact mean already
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    sums = np.array(_summed(usable(vectors).where(F.size("embedding") == dim), moments, k + k * k)) / model.n
    return float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max())


def whitened_components(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row a vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, components)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(identity_error(vectors, model)).alias("identity_error"),
    )
