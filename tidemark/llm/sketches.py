"""MinHash near-dedup on SetSketch registers.

A register holds the exponent, to base ``BASE``, of the least of exponentially spaced hash values of
the shingles, truncated to a byte: registers of a union are the larger ones of its parts (mergeable), and two
sets agree in a register about as often as their Jaccard similarity (locality-sensitive).

1. One pass over the texts gives the set size, a digest of the set and the registers.
2. Documents with the same set are one class; only class representatives go on.
3. Bands of registers put alike representatives into buckets. Each bucket's most connected member is its
   centre; a member meets its centre only (never all pairs).
4. Met pairs are estimated by joint likelihood of the registers and confirmed on whole sets, taken again from the
   texts of these documents alone (texts shrink on disk, sets of hashes do not); links give components.
5. Buckets that still hold several components compare those outside the largest one with all members, in
   blocks of longer register rows; a pair is looked at in the first band it shares only, and what the
   likelihood does not rule out is confirmed on whole sets too.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, by_sorting, columns, mixed, rows_out, stage, texts, window_hashes, word_hashes
from .components import components

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
BASE, RATE = 1.1, 20.0
#: Standard errors that an estimate may lie under the threshold.
SLACK = 4.5
#: Further registers of the members of buckets that stay open.
EXTRA = 896
_BLOCK = 256
#: Bits of the filter for each id that it lets through, and the most ids that get one; beyond, a join alone sorts the texts out.
_FILTER_BITS, _FILTER_IDS = 16, 1 << 23
#: Members of a bucket that one task compares with the bucket's odd ones.
_SPREAD = 4096
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("registers", pa.binary())])


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ASCII-lower-cased text; of the whole sequence if it is shorter."""
    h = word_hashes(text.lower().split()) if text else np.empty(0, np.uint64)
    return np.unique(window_hashes(h, min(words, len(h)))) if len(h) else h


def register_values(sets: list[np.ndarray], m: int = BANDS * ROWS, seed: int = 20240501) -> np.ndarray:
    """Registers (one byte each) of non-empty sets, one row a set."""
    rng = np.random.default_rng(seed)
    seeds = rng.integers(0, 1 << 63, m, np.uint64)
    odds = rng.integers(0, 1 << 63, m, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.empty((m, len(sets)), np.uint64)
    at = 0
    while at < len(sets):  # a piece stays in the cache
        end, size = at, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= 32_768):
            size += len(sets[end])
            end += 1
        s = np.concatenate(sets[at:end])
        bounds = np.cumsum([0, *map(len, sets[at : end - 1])])
        v = np.empty_like(s)
        for i in range(m):
            np.bitwise_xor(s, seeds[i], out=v)
            np.multiply(v, odds[i], out=v)
            least[i, at:end] = np.minimum.reduceat(v, bounds)
        at = end
    u = (least.T.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-u) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


def sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Batches) -> Batches:
        import xxhash

        for batch in batches:
            ids, txt = columns(batch, "doc_id", "text")
            for at in range(0, len(ids), 500):
                sets = [shingle_set(t) for t in txt[at : at + 500]]
                full = [s for s in sets if len(s)]
                regs = iter(register_values(full) if full else ())
                yield rows_out(
                    _SKETCH,
                    ids[at : at + 500],
                    [len(s) for s in sets],
                    [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    [next(regs).tobytes() if len(s) else None for s in sets],
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers binary")


def _similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity from how many registers are larger, smaller, equal, and the set sizes."""
    m = a.shape[-1]
    out = np.zeros(len(a))
    # with fewer equal registers no estimate comes near a threshold in use
    at = np.flatnonzero((a == b).sum(-1, dtype=np.int16) >= m * (_floor(m) - 0.1))
    up, down = (a[at] > b[at]).sum(-1), (a[at] < b[at]).sum(-1)
    na, nb = na[at], nb[at]
    u = na / (na + nb)
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def log_likelihood(j):
        p = -np.log1p(-np.clip(u - v * j, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
        q = -np.log1p(-np.clip(v - u * j, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
        return up * np.log(p) + down * np.log(q) + (m - up - down) * np.log(np.maximum(1 - p - q, 1e-12))

    lo, hi = np.zeros(top.shape), top.copy()
    for _ in range(16):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = log_likelihood(x) >= log_likelihood(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    out[at] = (lo + hi) / 2
    return out


def _floor(m: int) -> float:
    """The least estimate from m registers that a pair of similarity PERCENT gets, SLACK standard errors down."""
    t = PERCENT / 100
    return t - SLACK * float(np.sqrt(t * (1 - t) / m))


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _likely(batches: Batches) -> Batches:
    for batch in batches:
        a, b, ra, rb, na, nb = columns(batch, "a", "b", "ra", "rb", "na", "nb")
        if a:
            ok = _similarity(_matrix(ra), _matrix(rb), np.array(na, float), np.array(nb, float)) >= _floor(BANDS * ROWS)
            yield rows_out(_PAIR, np.array(a)[ok], np.array(b)[ok])


@lru_cache(maxsize=32)
def _set_of(text: bytes) -> np.ndarray:
    """The set of a text; a centre stands in many pairs in a row."""
    return shingle_set(text)


def _confirmed(batches: Batches) -> Batches:
    for batch in batches:
        keep_a, keep_b = [], []
        for a, b, ta, tb in zip(*columns(batch, "a", "b", "ta", "tb"), strict=True):
            sa, sb = _set_of(ta), _set_of(tb)
            na, nb = len(sa), len(sb)
            if not min(na, nb) or 100 * min(na, nb) < PERCENT * max(na, nb):
                continue
            both = np.concatenate([sa, sb])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= PERCENT * (na + nb - common):
                keep_a.append(a)
                keep_b.append(b)
        yield rows_out(_PAIR, keep_a, keep_b)


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text of the documents whose doc_id is among ids (one long column), and of few others.

    A bitmap of _FILTER_BITS bits an id, 16 MB of bits at most (the one table here that is broadcast), leaves most other texts out before any shuffle; for more ids than _FILTER_IDS
    a semi-join does.
    """
    n = ids.count()
    if n > _FILTER_IDS:
        return texts(docs).where("doc_id is not null and text is not null").join(by_sorting(ids.toDF("doc_id").distinct()), "doc_id", "left_semi")
    bits_in_all = 1 << max(16, (n * _FILTER_BITS - 1).bit_length())
    h = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(bits_in_all))
    word, bit = F.shiftright(h, 6), (h % 64).cast("int")
    bits = ids.toDF("doc_id").select(word.alias("word"), F.expr("shiftleft(1L, cast(pmod(pmod(xxhash64(doc_id), %d), 64) as int))" % bits_in_all).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    whole = texts(docs).where("doc_id is not null and text is not null").select("doc_id", "text", word.alias("word"), bit.alias("at"))
    return whole.join(F.broadcast(bits), "word").where(F.expr("(shiftrightunsigned(bits, at) & 1L) = 1L")).select("doc_id", "text")


def _links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs a, b those whose whole sets are alike enough."""
    whole = _texts_of(pairs.select("a").union(pairs.select("b")), docs)
    left, right = whole.toDF("a", "ta"), whole.toDF("b", "tb")
    return pairs.join(by_sorting(left), "a").join(by_sorting(right), "b").select("a", "b", "ta", "tb").mapInArrow(_confirmed, "a long, b long")


def _longer(batches: Batches) -> Batches:
    """Registers of members of open buckets: those of the sketch, and EXTRA more."""
    out = pa.schema([("rep", pa.int64()), ("registers", pa.binary())])
    for batch in batches:
        reps, regs, whole = columns(batch, "rep", "registers", "text")
        for at in range(0, len(reps), 200):
            full = [(rep, r, s) for rep, r, t in zip(reps[at : at + 200], regs[at : at + 200], whole[at : at + 200], strict=True) if len(s := shingle_set(t))]
            if full:
                more = register_values([mixed(s) for _, _, s in full], EXTRA, 7)
                yield rows_out(out, [rep for rep, _, _ in full], [r + m.tobytes() for (_, r, _), m in zip(full, more, strict=True)])


def _block_pairs(batches: Batches) -> Batches:
    m = BANDS * ROWS
    for batch in batches:
        for band, odd, members in zip(*columns(batch, "band", "odd", "members"), strict=True):
            x, y = _matrix([r["registers"] for r in odd]), _matrix([r["registers"] for r in members])
            ids, other = np.array([r["rep"] for r in odd]), np.array([r["rep"] for r in members])
            comp, far = np.array([r["component"] for r in odd]), np.array([r["component"] for r in members])
            n, k = np.array([r["n"] for r in odd], float), np.array([r["n"] for r in members], float)
            bands_x, bands_y = (np.ascontiguousarray(z[:, :m]).view(f"V{ROWS}").reshape(len(z), BANDS).view(f"u{ROWS}") for z in (x, y))
            step = max(1, 2**21 // (len(other) * BANDS))
            for i in range(0, len(ids), step):
                part = slice(i, i + step)
                fit = (comp[part, None] != far) & (np.minimum(n[part, None], k) * 100 >= PERCENT * np.maximum(n[part, None], k))
                fit &= ~(bands_x[part, None, :band] == bands_y[None, :, :band]).any(-1)
                a, b = np.nonzero(fit)
                a += i
                for size in (m, m + EXTRA):
                    ok = [_similarity(x[a[c : c + 8192], :size], y[b[c : c + 8192], :size], n[a[c : c + 8192]], k[b[c : c + 8192]]) >= _floor(size) for c in range(0, len(a), 8192)]
                    if ok:
                        a, b = a[np.concatenate(ok)], b[np.concatenate(ok)]
                if len(a):
                    yield rows_out(_PAIR, np.minimum(ids[a], other[b]), np.maximum(ids[a], other[b]))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept (doc_id = component_id).

    Texts that are null, empty or only white space have no shingles and link with nothing. Rows that repeat a
    doc_id are one node. A null doc_id gives a null component_id and kept = false. Texts of any length are compared whole (their
    sets are formed in memory that grows with the one text); an empty table gives no rows. Other columns play no part.
    """
    rows = stage(sketches(docs))
    classes = stage(rows.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")))
    band: Column = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    keys = classes.select("rep", "registers", band.alias("band")).select(F.expr(f"xxhash64(band, substring(registers, {ROWS} * band + 1, {ROWS}))").alias("key"), "band", "rep")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = stage(keys.join(by_sorting(shared), "key"))

    degree = buckets.groupBy("rep").agg(F.sum("size").alias("degree"))
    centres = buckets.join(by_sorting(degree), "rep").groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("centre"))
    star = stage(buckets.join(by_sorting(centres), "key").where("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct())
    few = classes.select("rep", "n", "registers")
    likely = stage(star.join(by_sorting(few.toDF("a", "na", "ra")), "a").join(by_sorting(few.toDF("b", "nb", "rb")), "b").mapInArrow(_likely, "a long, b long").distinct())
    links = stage(_links(likely, docs))
    found = components(links)

    held = buckets.where("size > 2").join(by_sorting(found), buckets["rep"] == found["v"], "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("component"))
    parts = held.groupBy("key", "component").agg(F.count("*").alias("c"))
    several = parts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("most"), F.count("*").alias("parts"), F.sum("c").alias("total")).where("parts > 1")
    opened = stage(held.join(by_sorting(several.select("key", "total", F.col("most.component").alias("largest"))), "key"))
    whole = _texts_of(opened.select("rep").distinct(), docs).withColumnRenamed("doc_id", "rep")
    longer = opened.select("rep").distinct().join(by_sorting(classes.select("rep", "registers")), "rep").join(by_sorting(whole), "rep").mapInArrow(_longer, "rep long, registers binary").groupBy("rep").agg(F.first("registers").alias("registers"))
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("total") / _BLOCK))
    member = F.struct("rep", "component", "n", "registers")
    blocks = stage(opened.join(by_sorting(classes.select("rep", "n")), "rep").join(by_sorting(longer), "rep").groupBy("key", "band", block.alias("block"), (F.col("component") != F.col("largest")).alias("outside")).agg(F.collect_list(member).alias("members"), F.ceil(F.first("total") / _SPREAD).alias("spread")))
    # a large bucket's members are dealt over several tasks; its odd blocks, never more of them, go to each
    odd = blocks.where("outside").select("key", "band", F.col("members").alias("odd"), F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"))
    dealt = blocks.select("key", "members", F.pmod(F.xxhash64("block", "outside"), F.col("spread")).alias("salt"))
    pairs = stage(odd.join(by_sorting(dealt), ["key", "salt"]).mapInArrow(_block_pairs, "a long, b long").distinct().join(by_sorting(star), ["a", "b"], "left_anti"))
    more = stage(_links(pairs, docs))
    if more.limit(1).count():
        found = components(links.unionByName(more))

    rep = classes.select("digest", "rep").join(by_sorting(found), F.col("rep") == found["v"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    joined = rows.select("doc_id", "n_shingles", "digest").join(by_sorting(rep), "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
