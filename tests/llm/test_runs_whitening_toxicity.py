"""Periodic runs against brute force, whitening against numpy's double-precision solver, toxicity on held-out texts; awkward rows for each."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periodic, queries, toxicity, whitening

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def brute_runs(w):
    """Every maximal stretch of every period, the smallest period of each."""
    n, seen = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                seen.setdefault((s, i - s + q), q)
    return sorted(((s, m, q) for (s, m), q in seen.items()), key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    """One row of op11 as its contract words it."""
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
    kept = hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], digest, kept)


def test_runs_of_sequences():
    r = random.Random(1)
    for _ in range(4000):
        n, letters = r.randint(0, 70), r.choice([1, 2, 2, 3, 6])
        w = [r.randrange(letters) for _ in range(n)]
        if n and r.random() < 0.6:
            s, p = r.randrange(n), r.randint(1, 1 + n // 3)
            w = [w[i] if i < s else w[s + (i - s) % p] for i in range(n)]
            if r.random() < 0.3:
                w[r.randrange(n)] = 0
        assert periodic.runs_of(np.array(w, np.int64)) == brute_runs(w)


def test_runs_of_long_sequences():
    assert periodic.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic.runs_of(np.arange(300_000) % 60_000) == [(0, 300_000, 60_000)]
    bits = [0]
    while len(bits) < 1 << 14:  # free of cubes
        bits += [1 - b for b in bits]
    assert periodic.runs_of(np.array(bits)) == []


def test_periodic_runs_of_documents(spark):
    r = random.Random(5)
    some = [" ".join(r.choice("abc") for _ in range(r.randint(0, 90))) for _ in range(150)]
    rows = [*enumerate(some), (None, "a b " * 9), (7, "x " * 40), (7, "x " * 40), (900, None), (901, ""), (902, " \n\t"), (903, "écrit " * 7 + "  ü"), (904, " ".join(f"w{i % 91}" for i in range(3000)))]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, runs string, a int").repartition(3)
    got = periodic.digest(periodic.find_runs(periodic.looped(docs))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(contract(i, t)) for i, t in rows)
    assert sum(r["n_runs"] for r in got) > 20
    assert periodic.digest(periodic.find_runs(periodic.looped(docs.limit(0)))).count() == 0


def test_periodic_runs_of_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 6000]
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    assert len(got) == docs.count() and len(rows) > 100
    for i, t in rows:
        assert got[i] == contract(i, t)


def whitened_rows(df, k):
    got = df.collect()
    z = {}
    for r in got:
        z.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    return got, np.array([[z[i][c] for c in range(1, k + 1)] for i in sorted(z)])


def test_whitening_of_the_table(spark):
    df = queries.op12_whitening(spark, SMALL)
    got, z = whitened_rows(df, 32)
    raw = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    x = np.floor(64 * np.array([raw[i] for i in sorted(raw)], float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    exact = dict(zip(sorted(raw), ((n * x - total).astype(object) ** 2).sum(1), strict=True))
    y = x - total / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = y @ (vectors[:, :32] / np.sqrt(values[:32]))
    want *= np.sign((want * z).sum(0))
    assert len(got) == 32 * n
    assert np.abs(z - want).max() < 1e-8
    assert np.abs(np.cov(z.T, bias=True) - np.eye(32)).max() < 1e-9
    for r in got:
        assert r["deviation"] == exact[r["vec_id"]] and r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-10)


def test_refined_handles_clusters():
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    for values in (np.ones(48), np.r_[[10.0] * 6, [10 + 1e-9] * 4, np.linspace(1, 9, 38)], np.r_[1e6 + 1e-6 * np.arange(20), np.linspace(1, 2, 28)], np.r_[np.linspace(1, 5, 30), np.zeros(18)]):
        a = (turn * values) @ turn.T
        a = (a + a.T) / 2
        e, x = whitening.refined(a.astype(np.longdouble), np.linalg.eigh(a.astype(np.float32))[1])
        top = np.abs(values).max()
        assert np.abs(np.sort(e.astype(float)) - np.linalg.eigvalsh(a)).max() < 1e-14 * top
        assert np.abs(x.T @ x - np.eye(48)).max() < 1e-15 and np.abs(a @ x - x * e).max() < 1e-15 * top


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(v) for v in rng.normal(size=5) * [1, 2, 3, 0, 1]], "x") for i in range(60)]
    odd = [(100, None, "x"), (101, [1.0, None, 0.0, 0.0, 0.0], "x"), (102, [1.0, float("nan"), 0.0, 0.0, 0.0], "x"), (103, [1.0, float("inf"), 0.0, 0.0, 0.0], "x"), (104, [], "x"), (105, [1.0, 2.0], "x"), (None, good[0][1], "x"), good[1]]
    df = spark.createDataFrame([*good, *odd], "vec_id long, embedding array<float>, n string").repartition(3)
    got = whitening.whitened_components(df).collect()
    # one dimension is constant: four components; the row without vec_id and the repeated one take part
    assert {r["component"] for r in got} == {1, 2, 3, 4} and {r["n"] for r in got} == {62}
    assert sorted({str(r["vec_id"]) for r in got}) == sorted({str(i) for i in [*range(60), None]}) and len(got) == 4 * 62
    assert max(r["identity_error"] for r in got) < 1e-9 and sum(r["explained"] for r in got if r["vec_id"] == 0) == pytest.approx(1)
    assert whitening.whitened_components(df.limit(0)).count() == 0
    assert whitening.whitened_components(df.where("vec_id = 3")).count() == 0  # equal vectors: no component
    huge = spark.createDataFrame([(1, [1e30]), (2, [-1e30]), (3, [0.5])], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["deviation"] is None for r in whitening.whitened_components(huge).collect()} == {1: True, 2: True, 3: False}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    pairs = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
    assert pairs.mean() > 0.98
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.985
    assert sum(r["predicted"] for r in rows if r["toxic"] == 1) / y.sum() > 0.9
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 3
    # calibration: scores mean what they say
    assert abs(s.mean() - y.mean()) < 0.02 and ((s - y) ** 2).mean() < 0.02


def test_toxicity_of_awkward_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, "you idiot"), (50_001, None), (50_002, ""), (50_003, "plain words " * 5), (50_003, "plain words " * 5), (50_004, "you are an 1d10t and a l0ser " * 3000)], "doc_id long, text string")
    some = docs.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit("x")).repartition(3)
    got = toxicity.classify(some, labels).collect()
    assert len(got) == docs.count() + 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[50_001]["score"] == by[50_002]["score"] and not by[None]["held_out"]
    assert {r["held_out"] for r in got if r["doc_id"] == 50_003} == {zlib.crc32(b"50003") % 5 == 0}
    again = {(r["doc_id"], r["score"]) for r in toxicity.classify(some.repartition(5), labels.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}
    none = toxicity.classify(some, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.classify(some.limit(0), labels).count() == 0


def test_toxicity_sees_what_hides_words():
    plain = toxicity.Lexicon()
    at = toxicity.NAMES.index
    hidden = toxicity.features("what an 1d10t , such a l.o.s.e.r", plain)
    assert hidden[at("hidden")] == pytest.approx(np.log1p(2)) and hidden[at("insult_count")] == 0
    near = toxicity.features("you are an idiot . " + "word " * 20 + "idiot", plain)
    assert near[at("near_count")] == pytest.approx(np.log1p(1)) and near[at("insult_count")] == pytest.approx(np.log1p(2))
    assert toxicity.features("STOP IT NOW!!! nooooo", plain)[at("shouted")] > 0 < toxicity.features("nooooo", plain)[at("stretched")]


def test_isotonic_is_the_nearest_rising_function():
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-3 * x))).astype(float)
    at, value = toxicity.isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all()
    y = y[np.argsort(x)]
    for k in range(0, 300, 29):
        nearest = max(min(y[i : j + 1].mean() for j in range(k, 300)) for i in range(k + 1))
        assert np.abs(value - nearest).min() < 0.01
