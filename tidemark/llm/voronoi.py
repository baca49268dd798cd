"""Exact top-k search: a Voronoi kNN join for integer inner products.

Pivots (a bounded sample, growing with the root of the rows) split the space into cells. Data are ordered by cell and distance to their
pivot and cut into blocks. A query's k best in its own block give a first threshold. Each cell's summary (least and greatest distance to the
pivot, greatest norm) bounds the products it can hold: by its ball, its ring, and the hyperplane to the query's own pivot. A block of queries is
replicated to the cells that can matter only, and there to each block, which bounds by its own ring before it multiplies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, columns, least_hashes, rows_out, shuffle_partitions, stage
from .vectors import usable

SCALE, K, EVERY = 256, 5, 50
#: Least and greatest number of pivots; between them the root of the rows.
PIVOTS = (64, 4096)
_BLOCK = 2048
_CELLS = pa.schema([("cell", pa.int32()), ("dim", pa.int32()), ("dist", pa.float64()), ("vec_id", pa.int64()), ("vec", pa.binary())])
_BLOCKS = pa.schema([("cell", pa.int32()), ("dim", pa.int32()), ("number", pa.int64()), ("near", pa.float64()), ("far", pa.float64()), ("norm", pa.float64()), ("ids", pa.binary()), ("vecs", pa.binary()), ("query_ids", pa.binary()), ("query_vecs", pa.binary()), ("least", pa.binary())])
_BLOCKS_DDL = "cell int, dim int, number long, near double, far double, norm double, ids binary, vecs binary, query_ids binary, query_vecs binary, least binary"


def quantized(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    return usable(embeddings).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("vec"))


def _squares(x: np.ndarray) -> np.ndarray:
    return (x.astype(float) ** 2).sum(-1)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, _squares(x)[:, None] + _squares(p)[None] - 2 * (x.astype(float) @ p.T)))


def _assign(pivots: dict[int, np.ndarray]):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, vecs = columns(batch, "vec_id", "vec")
            by: dict[int, list[int]] = {}
            for i, v in enumerate(vecs):
                by.setdefault(len(v), []).append(i)
            for dim, at in by.items():
                x = np.array([vecs[i] for i in at], np.int64).reshape(len(at), dim)
                p = pivots.get(dim, np.zeros((1, dim)))
                cell = _distances(x, p).argmin(1)
                dist = np.sqrt(((x - p[cell]) ** 2).sum(1))
                yield rows_out(_CELLS, cell.astype(np.int32), [dim] * len(at), dist, [ids[i] for i in at], [r.tobytes() for r in x])

    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; those beyond 64 bits are held at the ends."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64).reshape(len(q), len(x))


def _best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query the k best ids (not its own) and their scores; rows that repeat an id count with the best of them."""
    order = np.argsort(ids, kind="stable")
    ids, score = ids[order], _products(q, x)[:, order]
    head = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)) if len(ids) else np.empty(0, int)
    if len(head) < len(ids):
        ids, score = ids[head], np.maximum.reduceat(score, head, axis=1)
    out = []
    for own, s in zip(qids, score, strict=True):
        at = np.flatnonzero(ids != own)
        if len(at) > 4 * k:  # with all ties of the k-th best
            at = at[s[at] >= np.partition(s[at], -k)[-k]]
        at = at[np.lexsort((ids[at], -s[at]))[:k]]
        out.append((ids[at], s[at]))
    return out


def _cut(k: int, every: int):
    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def block(key, rows):
            ids = np.array([r[1] for r in rows], np.int64)
            x = np.frombuffer(b"".join(r[2] for r in rows), np.int64).reshape(len(rows), key[1])
            at = np.flatnonzero(ids % every == 0)
            best = _best(ids[at], x[at], ids, x, k) if len(at) else []
            least = np.array([s[-1] if len(s) == k else -np.inf for _, s in best], float)
            return rows_out(_BLOCKS, [key[0]], [key[1]], [number], [rows[0][0]], [rows[-1][0]], [float(np.sqrt(_squares(x).max()))], [ids.tobytes()], [x.tobytes()], [ids[at].tobytes()], [x[at].tobytes()], [least.tobytes()])

        key, rows = None, []
        for batch in batches:
            for cell, dim, dist, i, vec in zip(*columns(batch, "cell", "dim", "dist", "vec_id", "vec"), strict=True):
                if rows and (key != (cell, dim) or len(rows) == _BLOCK):
                    yield block(key, rows)
                    number, rows = number + 1, []
                key = (cell, dim)
                rows.append((dist, i, vec))
        if rows:
            yield block(key, rows)

    return run


def _ceiling(q: np.ndarray, p: np.ndarray, near: np.ndarray, far: np.ndarray, norm: np.ndarray, away: np.ndarray | float = 0.0) -> np.ndarray:
    """For each query and each cell (pivot p) the greatest product that vectors can have whose distance to p is in [near, far], whose
    norm is norm at most, and which are `away` from q at least. A little above, for rounding."""
    square, product = _squares(q)[:, None], q @ p.T.astype(float)
    to = np.sqrt(np.maximum(0, square + _squares(p)[None] - 2 * product))
    apart = np.maximum(np.maximum(to - far, near - to), np.maximum(away, 0))
    ring = (square + norm**2 - np.maximum(0, apart - 1e-6 * (1 + to)) ** 2) / 2
    ball = product + np.sqrt(square) * far
    return np.minimum(ring, ball) + 1e-6 * (1 + np.abs(product) + square)


def _needed(pivots: dict[int, np.ndarray], cells: dict[tuple[int, int], tuple]):
    """Queries with their least useful products, some _BLOCK together, once for each block of each cell that can hold one."""
    out = pa.schema([("cell", pa.int32()), ("dim", pa.int32()), ("salt", pa.int64()), ("query_ids", pa.binary()), ("query_vecs", pa.binary()), ("least", pa.binary())])

    def send(dim: int, parts: list) -> Batches:
        ids, q, least = (np.concatenate(c) for c in zip(*parts, strict=True))
        p = pivots.get(dim, np.zeros((1, dim)))
        here = sorted(c for c, d in cells if d == dim)
        near, far, norm, blocks = (np.array(v) for v in zip(*(cells[c, dim] for c in here), strict=True))
        to = _distances(q, p)
        own = to.argmin(1)
        between = _distances(p[own], p)[:, here]
        beyond = (to[:, here] ** 2 - to[np.arange(len(q)), own][:, None] ** 2) / (2 * np.maximum(between, 1e-9))
        need = _ceiling(q, p[here], near, far, norm, np.where(between > 0, beyond, 0.0)) >= least[:, None]
        for j, c in enumerate(here):
            m = need[:, j]
            if m.any():
                n = int(blocks[j])
                yield rows_out(out, [c] * n, [dim] * n, list(range(n)), [ids[m].tobytes()] * n, [q[m].tobytes()] * n, [least[m].tobytes()] * n)

    def run(batches: Batches) -> Batches:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, raw, vecs, floor in zip(*columns(batch, "dim", "query_ids", "query_vecs", "least"), strict=True):
                if not raw:
                    continue
                parts = held.setdefault(dim, [])
                ids = np.frombuffer(raw, np.int64)
                parts.append((ids, np.frombuffer(vecs, np.int64).reshape(len(ids), dim), np.frombuffer(floor)))
                if sum(len(x[0]) for x in parts) >= _BLOCK:
                    yield from send(dim, held.pop(dim))
        for dim, parts in held.items():
            yield from send(dim, parts)

    return run


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("products", pa.int64())])
_FOUND_DDL = "query_id long, vec_id long, score long, products long"


def _solve(pivots: dict[int, np.ndarray], k: int):
    """The best of each pair of blocks; a row without ids counts the products computed for it."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for cell, dim, near, far, norm, raw, vecs, qraw, qvecs, least in zip(*columns(batch, "cell", "dim", "near", "far", "norm", "ids", "vecs", "query_ids", "query_vecs", "least"), strict=True):
                ids, qids, floor = np.frombuffer(raw, np.int64), np.frombuffer(qraw, np.int64), np.frombuffer(least)
                x, q = np.frombuffer(vecs, np.int64).reshape(len(ids), dim), np.frombuffer(qvecs, np.int64).reshape(len(qids), dim)
                ok = _ceiling(q, pivots.get(dim, np.zeros((1, dim)))[cell : cell + 1], near, far, norm)[:, 0] >= floor
                q, qids, floor = q[ok], qids[ok], floor[ok]
                cols: list[list] = [[None], [None], [None], [len(q) * len(x)]]
                for own, low, (at, s) in zip(qids, floor, _best(qids, q, ids, x, k) if len(q) else (), strict=True):
                    useful = s >= low
                    cols[0] += [int(own)] * int(useful.sum())
                    cols[1] += at[useful].tolist()
                    cols[2] += s[useful].tolist()
                yield rows_out(_FOUND, *cols[:3], cols[3] + [None] * (len(cols[0]) - 1))

    return run


def _searched(embeddings: DataFrame, k: int, every: int, pivots: tuple[int, int]) -> DataFrame:
    spark = embeddings.sparkSession
    every_row = quantized(embeddings)
    total = every_row.count()
    wanted = min(pivots[1], max(pivots[0], math.ceil(math.sqrt(total))))
    points: dict[int, list] = {}
    for r in least_hashes(every_row, wanted, "vec_id", "vec", total=total).select("vec").collect():
        points.setdefault(len(r["vec"]), []).append(r["vec"])
    centres = {d: np.unique(np.array(v, float).reshape(len(v), d), axis=0) for d, v in points.items()}
    cells = every_row.distinct().mapInArrow(_assign(centres), "cell int, dim int, dist double, vec_id long, vec binary")
    ordered = cells.repartitionByRange(shuffle_partitions(spark), "dim", "cell", "dist", "vec_id").sortWithinPartitions("dim", "cell", "dist", "vec_id")
    blocks = stage(ordered.mapInArrow(_cut(k, every), _BLOCKS_DDL))
    # one row a cell: as many as pivots
    cell = blocks.groupBy("cell", "dim").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.max("norm").alias("norm"), F.count("*").alias("blocks"))
    summary = {(r["cell"], r["dim"]): (r["near"], r["far"], r["norm"], r["blocks"]) for r in cell.collect()}
    asked = blocks.select("dim", "query_ids", "query_vecs", "least").mapInArrow(_needed(centres, summary), "cell int, dim int, salt long, query_ids binary, query_vecs binary, least binary")
    # a cell's blocks are dealt over as many keys, so that a cell that holds most rows is no single task
    counts = spark.createDataFrame([(c, d, s[3]) for (c, d), s in summary.items()], "cell int, dim int, blocks long")
    placed = blocks.drop("query_ids", "query_vecs", "least").join(F.broadcast(counts), ["cell", "dim"])
    dealt = placed.withColumn("salt", F.pmod(F.xxhash64("number"), F.col("blocks")))
    return dealt.join(asked, ["cell", "dim", "salt"]).mapInArrow(_solve(centres, k), _FOUND_DDL)


def products_computed(embeddings: DataFrame, k: int = K, every: int = EVERY, pivots: tuple[int, int] = PIVOTS) -> int:
    """How many inner products the search computes between blocks: what the bounds leave of queries times rows."""
    return _searched(embeddings, k, every, pivots).agg(F.coalesce(F.sum("products"), F.lit(0))).first()[0]


def top_products(embeddings: DataFrame, k: int = K, every: int = EVERY, pivots: tuple[int, int] = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` the k others of largest integer products.

    Vectors that are null or hold null or non-finite components, or have no vec_id, take no part. Vectors of another
    length than the query's are no candidates. Ties go to the smaller vec_id. Rows that repeat a vec_id are one candidate and one
    query: the best product of any two of their vectors counts. An empty table gives no rows; other columns play no part. pivots bounds
    the sample that the driver sees. Products beyond 64 bits are held at the ends.
    """
    best = _searched(embeddings, k, every, pivots).where("query_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, MAX(list_inner_product(q.v, c.v)::BIGINT) AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
