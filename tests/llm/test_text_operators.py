"""Each text operator against brute force on a fixture of awkward rows: nulls, empty and long texts, repeated rows, empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, common, components, curves, mixing, packing, pages, pii, quality, repeats, sketches, voronoi

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("abcdefghij") + r.choice("klmnop") + str(r.randint(0, 9)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base, other = words(120, 1), words(90, 2)
    near = base[:60] + ["changed"] + base[61:]
    rows = [
        (1, " ".join(base), "en", "a"),
        (2, " ".join(near), "en", "b"),
        (3, " ".join(other[:30] + base[10:50] + other[30:]), None, None),
        (4, " ".join(base), "en", "a"),
        (5, "", "en", "b"),
        (6, None, "en", "b"),
        (7, " \n\t ", "en", "c"),
        (8, "Ab cd", "en", "c"),
        (9, "ab CD", "en", "a"),
        (10, " ".join(["loop"] * 3000), "en", "a"),
        (11, " ".join(words(9000, 3)), "en", "a"),
        (11, " ".join(words(9000, 3)), "en", "a"),
        (None, " ".join(base), "en", "a"),
        (13, "Prompt line\nx <|endoftext|> y<|startoftext|>Don't STOP!!! İ? 12", "en", "b"),
        (12, "écrit à me.x9@mail.example.com, 10.0.0.255 or 4417744280351547; +1 (212) 555-0198.", "fr", "a"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).withColumn("spans", F.lit(1)).withColumn("size", F.lit("x"))
    return df.repartition(3)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    per = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        per[r["source"]][0] += r["size"]
        per[r["source"]][1] = r["target"]
        per[r["source"]][2] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for size, target, taken in per.values():
        assert abs(taken - target) <= 1 and target <= 2 * size
    assert sum(v[1] for v in per.values()) == pytest.approx(1.5 * sum(v[0] for v in per.values()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_near_duplicates(spark, docs):
    rows = rows_of(docs)
    sets = defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i].append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    parent = {i: i for i in sets if i is not None}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in parent:
        for b in parent:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = sketches.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
        assert r["component_id"] == (find(r["doc_id"]) if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"])
    assert sketches.near_duplicates(docs.limit(0)).count() == 0


def test_repeats(spark, docs):
    rows = rows_of(docs)
    first = {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        w = (t or "").encode().split()
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            first[k] = min(first.get(k, (i, j)), (i, j))
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - 19):
            if i is not None and first[tuple(w[j : j + 20])] < (i, j):
                gone.update(range(j, j + 20))
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    got = [tuple(r) for r in repeats.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_repeats_compact_paths_that_do_not_branch(spark):
    """Three documents repeat one passage whole, a fourth its middle only: the graph branches where the fourth enters."""
    passage, own = words(400, 31), [words(30, 40 + i) for i in range(8)]
    rows = [(1, passage), (2, own[0] + passage + own[1]), (3, own[2] + passage + own[3]), (4, own[4] + passage + own[5]), (5, own[6] + passage[150:260] + own[7]), (6, passage[:100] + ["odd"] + passage[101:])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    found = repeats.pieces(df).cache()
    n_arcs, n_heads = repeats.arcs(found).count(), repeats.heads(found).count()
    assert n_heads == n_arcs > 0
    spans = defaultdict(list)
    for r in repeats.paths(df).collect():
        assert r["n"] > 0 and rows[r["doc"] - 1][1][r["start"] : r["start"] + r["n"] + 19] == rows[r["src"] - 1][1][r["src_start"] : r["src_start"] + r["n"] + 19]
        spans[r["doc"]].append((r["start"], r["n"]))
    # compacted: fewer spans than pieces, but no longer ones than the repeated passages
    assert sum(map(len, spans.values())) < found.count() / 2
    for doc, lo, n in ((2, 30, 381), (3, 30, 381), (4, 30, 381), (5, 30, 91)):
        assert {x for s, m in spans[doc] for x in range(s, s + m)} == set(range(lo, lo + n))
    straight = df.where("doc_id in (1, 2)")
    assert [(r["start"], r["n"]) for r in repeats.paths(straight).collect()] == [(30, 381)]


def test_packing_round_trip(spark, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = packing.pack(docs).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    for i, text in rows_of(docs):
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        copies = 2 if i == 11 else 1
        pieces = sorted(by[i], key=lambda r: r["start"])
        assert sum(len(p["ids"]) for p in pieces) == copies * len(want)
        assert all(want[4 * p["start"] : 4 * (p["start"] + p["length"])] == p["ids"] and p["doc_tokens"] * 4 == len(want) for p in pieces)
    for pieces in seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 4096 or at & (at - 1) == 0
    d = packing.digest(packing.pack(docs.where("doc_id = 12"))).collect()
    assert all(0 <= r["ids_crc32"] < 2**32 for r in d)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [(64, 3, 40), (64, 40, 20), (64, 3, 64), (64, 64, 1)])
def test_packer_holds_every_limit(limits):
    packer, r = packing.Packer(limits), random.Random(4)
    rows, bears, sizes = [], {}, {}
    for i in range(1500):
        sizes[i] = r.randint(1, 150) if i % 7 == 0 else r.randint(1, 12)
        bears[i] = r.randint(0, sizes[i])
        rows += packer.add(i, b"\1\0\0\0" * sizes[i], bears[i])
    rows += packer.close()
    seq, seen = defaultdict(list), defaultdict(list)
    for x in rows:
        seq[x[5]].append(x)
        seen[x[0]] += range(x[1], x[1] + x[2])
    assert all(sorted(seen[i]) == list(range(n)) for i, n in sizes.items())
    for v in seq.values():
        assert sum(x[2] for x in v) <= limits[0] and len(v) <= limits[1]
        assert sum(max(0, x[1] + x[2] - max(x[1], bears[x[0]])) for x in v) <= limits[2]
    # each limit that is tight closes sequences
    assert packer.closed[{3: "segments", 40: "loss", 64: "loss"}[limits[1]]] > 0


def test_encoder_gives_the_plain_ids():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(path("word_bpe_49k.json")), random.Random(5)
    parts = [*"abcABC éÉßΣİſKÅﬁǄǅ×÷ƻɁɐ中한٣.,!?%&'-_\n\t", "\u0301", "\u00a0", "\u200b", "'s", "'t", "12", "<|endoftext|>", "<|startoftext|>", "the "]
    some = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(4000)]
    assert [np.frombuffer(c, "<u4").tolist() for c in packing._encoder(None).encode([x.encode() for x in some])] == [t.encode(x, add_special_tokens=False).ids for x in some]


def test_personal_data(spark, docs):
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    r = got[12]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    base = pii.base_spans(next(t for i, t in rows_of(docs) if i == 12))
    joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
    assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert set(joined.split(",")) <= set(r["spans"].split(","))
    assert got[6]["spans"] == "" and got[5]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {x["doc_id"]: x for x in pii.redact(docs).collect()}
    assert "[EMAIL]" in clean[12]["text"] and "@" not in clean[12]["text"] and clean[6]["text"] is None
    assert clean[12]["n_chars"] == len(clean[12]["text"])
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_quality_equals_a_plain_discriminant(spark):
    """The shrunk covariances and densities written out with solve and slogdet, from the statistics of the training fold."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = {r["doc_id"]: quality.statistics((r["text"] or "").encode()) for r in d.collect()}
    train = [(r["quality"], stats[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in stats and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    x = {c: np.array([v for q, v in train if q == c]) for c in (0, 1)}
    centred = {c: v - v.mean(0) for c, v in x.items()}
    pooled = sum(v.T @ v for v in centred.values()) / len(train)
    k = pooled.shape[0]

    def density(v, c):
        n = len(x[c])
        own = quality.POOLED + (1 - quality.POOLED) * k / (n + k)
        cov = (1 - quality.DIAGONAL) * ((1 - own) * centred[c].T @ centred[c] / n + own * pooled) + quality.DIAGONAL * np.diag(np.diag(pooled) + 1e-6)
        y = v - x[c].mean(0)
        return np.log(n / len(train)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * y @ np.linalg.solve(cov, y)

    for r in quality.classify(d.withColumn("stats", F.lit("x")).withColumn("quality", F.lit(3)), labels.withColumn("text", F.lit("y"))).collect():
        v = np.array(stats[r["doc_id"]])
        want = 1 / (1 + np.exp(-np.clip((density(v, 1) - density(v, 0)) / quality.TEMPER, -40, 40)))
        assert r["score"] == pytest.approx(want, abs=1e-6)
        assert r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(d, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)


def test_quality_awkward_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert len(got) == docs.count() and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    assert quality.keep_good(docs, none).count() == docs.count()


def test_pages(spark):
    html = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><script>var t='</p>';</script><div class='ad'>Buy now</div><article><h1>A &amp; B</h1><p>First  <b>bold\n text.<br><p>Second one.</p><div class=comments><p>Nice post, thanks a lot for it.</p></div></article><aside>More</aside><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", html), (2, None, None), (3, "v", ""), (None, "w", "<p>" + "word " * 50), (5, "x", "<" * 5000)]
    got = {r["page_id"]: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "A & B\nFirst bold text.\nSecond one." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0
    assert got[None]["text"] == ("word " * 50).strip()


def test_minimum_cut_is_least():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 7)
        lean = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 1.5)) for i in range(n) for j in range(i) if r.random() < 0.5]
        cost = lambda keep: sum(abs(x) for x, k in zip(lean, keep, strict=True) if (x > 0) != k and x) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(pages.minimum_cut(lean, edges)) == pytest.approx(best)


def test_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "c"), (5, 0, None, None), (5, 0, None, None), (None, 0, "user", "z"), (6, 0, "user", "")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {3, 5, 6}
    assert got[3]["text"] == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n" and got[5]["n_turns"] == 1


def test_chats_awkward_tables(spark):
    ddl = "conv_id long, turn long, role string, text string"
    assert chat.format_chats(spark.createDataFrame([], ddl)).count() == 0
    long = [(1, i, "user" if i % 2 else "assistant", f"turn {i} " * (20_000 if i == 5 else 1)) for i in range(400)]
    rows = [*long, *((2, *r[1:]) for r in long[:399]), *((3, *r[1:]) for r in long), (None, 0, None, None)]
    df = spark.createDataFrame(rows, ddl).withColumn("id", F.lit("x")).withColumn("turns", F.lit(1)).withColumn("ids", F.lit(None))
    got = chat.format_chats(df.union(df)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(1, 400)]
    assert got[0]["text"] == "".join(f"<|{r[2]}|>\n{r[3]}<|end|>\n" for r in long)


def test_near_duplicates_of_large_open_buckets(spark, monkeypatch):
    """Many variants around one text: buckets stay open with several components, small blocks and several tasks a bucket."""
    for name, value in (("_BLOCK", 4), ("_SPREAD", 8), ("_FILTER_IDS", 3)):
        monkeypatch.setattr(sketches, name, value)
    r = random.Random(3)
    base = words(60, 7)
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"new{r.randint(0, 5)}"
        rows.append((i, " ".join(w)))
    sets = {i: frozenset(tuple(t.split()[j : j + 5]) for j in range(56)) for i, t in rows}
    parent = list(range(90))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = sketches.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: find(i) for i in range(90)}


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(120)] + [(1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8), (1003, [0.0] * 8), (1050, [1.0, 2.0]), (None, rows[0][1]), (50, rows[50][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def usable(vectors):
    found = {(r["vec_id"], tuple(r["embedding"])) for r in vectors.collect() if r["vec_id"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"])}
    return sorted(found)


def best_products(rows, every=50, k=5):
    best = defaultdict(dict)
    for i, q in rows:
        if i % every == 0:
            for j, v in rows:
                if j != i and len(v) == len(q):
                    p = max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(q, v, strict=True))))
                    best[i][j] = max(p, best[i].get(j, p))
    return {(i, r + 1, j, -s) for i, found in best.items() for r, (s, j) in enumerate(sorted((-s, j) for j, s in found.items())[:k])}


def test_exact_search(spark, vectors):
    rows = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in usable(vectors)]
    clashing = vectors.withColumn("cell", F.lit("x")).withColumn("dim", F.lit(1)).withColumn("score", F.lit(None))
    assert {tuple(r) for r in voronoi.top_products(clashing).collect()} == best_products(rows)
    assert voronoi.top_products(vectors.limit(0)).count() == 0


def test_exact_search_repeated_ids_and_large_components(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in r.normal(size=3)]) for i in r.integers(0, 120, 400)] + [(50, [1e6, -1e6, 3e6]), (51, [1e7, 2e7, 1e6]), (100, [2.0**40, 1.0, -1.0]), (101, [2.0**38, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {tuple(x) for x in voronoi.top_products(df).collect()}
    assert got == best_products([(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows])


def test_exact_search_bounds_leave_out_far_cells(spark):
    r = np.random.default_rng(6)
    centres = r.normal(size=(40, 8))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, [float(x) for x in centres[i % 40] + 0.02 * r.normal(size=8)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert voronoi.products_computed(df) < 0.2 * 80 * 4000
    assert {tuple(x) for x in voronoi.top_products(df).collect()} == best_products([(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows])


def test_curves_recall(spark, vectors):
    rows = [(i, np.array(v)) for i, v in usable(vectors) if any(v)]
    got = defaultdict(list)
    for r in curves.nearest(vectors.withColumn("curve", F.lit("x")).withColumn("key", F.lit(1)).withColumn("score", F.lit(None)), share=0.1).collect():
        got[r["query_id"]].append(r)
    hit = total = 0
    for i, q in rows:
        if i % 100 == 0:
            best = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in rows if j != i and len(v) == len(q))[:10]
            hit += len({j for _, j in best} & {r["vec_id"] for r in got[i]})
            total += len(best)
            for r in got[i]:
                assert r["score"] == pytest.approx(float(np.sqrt(((q - dict(rows)[r["vec_id"]]) ** 2).sum())), rel=1e-12)
    assert hit >= 0.9 * total
    assert curves.nearest(vectors.limit(0)).count() == 0


def test_pipeline_keeps_columns_of_any_name_and_empty_tables(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = {c: F.lit("keep") for c in ("copy", "s", "d", "z", "z0", "times", "of", "least", "document", "place", "row", "id", "n", "slot", "pass", "stats", "size", "used", "key")}
    wide = docs.withColumns(more).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    for name, f in corpus_pipeline.STAGES[:-1]:
        narrow, got = f(spark, docs, folder), f(spark, wide, folder)
        assert got.columns == wide.columns, name
        assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, narrow.collect())), name
        assert all(r[c] == "keep" for r in got.select(*(F.col(f"`{c}`") for c in more)).distinct().collect() for c in more if c in r.asDict()), name
        assert f(spark, wide.limit(0), folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, wide.limit(0), folder).count() == 0


def test_mixing_stage_follows_the_slots(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs, "").collect()]
    want = sorted((r["first_slot"], r["doc_id"]) for r in mixing.passes(docs).where("size > 0 and 2 * used >= size").collect())
    assert got == [i for _, i in want]


def test_mixing_schedule_has_low_discrepancy(spark):
    aims = spark.createDataFrame([("a", 1, 1, 5.0, 3e5, 300_000, 0, 2576980377), ("b", 1, 2, 2.0, 1.5e5, 150_000, 2576980377, 3865470566), ("c", 1, 3, 1.0, 5e4, 50_000, 3865470566, 1 << 32)], "source string, source_size long, sid int, weight double, target double, quota long, lo long, hi long")
    rows = sorted((r["slot"], r["sid"], r["rank"], r["words"]) for r in mixing.schedule(aims).collect())
    assert len({r[0] for r in rows}) == len(rows)
    for sid, quota in ((1, 300_000), (2, 150_000), (3, 50_000)):
        own = [r for r in rows if r[1] == sid]
        assert [r[2] for r in own] == list(range(len(own))) and sum(r[3] for r in own) == quota
        for n in (50, 200, 500, 900):  # of the first n slots a share that is off by a few at most
            assert abs(sum(r[0] <= n for r in own) - n * quota / 500_000) < 4


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, f(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.columns == before.columns, name
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids


LONG = "This paragraph stands for real content of the page and it is long enough to count as one, with more than twenty five words in it so that nobody doubts it at all."


@pytest.mark.parametrize(
    "part",
    [
        f"<section id='discussion'><h2>Discussion</h2><p>{LONG}</p><p>{LONG}</p></section>",
        f"<h2 id='related-work'>Related work</h2><p>{LONG}</p><h2 id='search-results'>Results</h2><p>{LONG}</p>",
        f"<section id='cookies'><h2>Cookies</h2><p>{LONG}</p></section>",
        f"<div class='notice'><p>{LONG}</p></div><div class='post-header'><p>{LONG}</p></div>",
        f"<div class='section' id='tags'><p>{LONG} <a href=x>one link</a></p></div><dl><dt id='menu'>Menu</dt><dd>{LONG}</dd></dl>",
    ],
)
def test_pages_keep_content_with_ambiguous_names(part):
    want = [" ".join(x.split()) for x in re.split("<[^>]*>", part.replace(" <a href=x>", " ").replace("</a>", "")) if x.strip()]
    for around in ("article", "main"):
        assert pages.main_text(f"<body><nav>Home</nav><{around}><h1>Title</h1><p>{LONG}</p>{part}</{around}><footer>f</footer></body>").split("\n") == ["Title", LONG, *want]
    if "section" in part and "discussion" in part:  # no element tells the content
        assert pages.main_text(f"<body><h1>Title</h1>{part}</body>").split("\n") == ["Title", *want]


def test_pages_keep_articles_by_topic_and_drop_boilerplate_by_name():
    html = f"<body><article class='post category-advertising tag-search has-sidebar'><h1>Title</h1><p>{LONG}</p>"
    for gone in (
        "<div class='related'><a href=x>Some other post that is here</a> <a href=y>And one more post</a></div>",
        f"<section id='discussion'><h3>Say</h3><div class='comment'><p>{LONG}</p></div><div class='comment'><p>{LONG}</p></div></section>",
        f"<div id='sidebar'><p>{LONG}</p></div><div class='newsletter-signup'><p>{LONG}</p></div><div class='comments-area'><p>{LONG}</p></div>",
        f"<div class='share-buttons'>Share it with all of your friends</div><div hidden><p>{LONG}</p></div>",
        "<p class='tags'>Tags: <a href=x>economy</a>, <a href=y>politics</a></p>",
    ):
        assert pages.main_text(html + gone + "</article></body>").split("\n") == ["Title", LONG], gone
        assert pages.main_text(html + f"</article><div class='notice'><p>{LONG}</p></div><div id='cookie-banner'><p>{LONG}</p></div></body>").split("\n") == ["Title", LONG]


def test_pages_cut_decides_where_blocks_alone_do_not(spark):
    """Names that tell the content are removed: short blocks inside the content are kept by their neighbours alone."""
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy("page_id").limit(700).collect()]
    weights = pages.fit_weights(*map(np.array, zip(*[e for h in rows[:200] for e in pages.examples(h)], strict=True)))
    right = {True: 0, False: 0}
    for html in rows[200:]:
        want = pages.main_text(html, weights)
        plain = re.sub(r"<(/?)(p|h1)\b[^>]*>", r"<\1div>", html)
        blocks = pages.read(plain)
        lean = pages.log_odds(blocks, weights)
        for cut, keep in ((True, pages.minimum_cut(lean, pages._edges(blocks))), (False, [x > 0 for x in lean])):
            right[cut] += "\n".join(b[0] for b, k in zip(blocks, keep, strict=True) if k) == want
    assert right[True] > right[False] + 10


def test_pages_learned_costs_and_awkward_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert not np.allclose(pages.learned(d), pages.PRIOR) and np.array_equal(pages.learned(d), pages.learned(d.repartition(5)))
    none = d.limit(0)
    assert np.array_equal(pages.learned(none), pages.PRIOR) and pages.extract(none).count() == 0
    twice = d.union(d).withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(None))
    got = pages.extract(twice)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 2 * d.count() and got.distinct().count() == d.count()
    want = {r["page_id"]: re.search("<article>(.*)</article>", r["html"], re.S)[1] for r in d.collect()}
    for r in got.collect():
        assert r["text"] == pages.main_text(f"<article>{want[r['page_id']]}</article>", np.array([9.0] + [0.0] * 13)), r["page_id"]


def test_pages_long_and_deep_pages_take_linear_time():
    import time

    def seconds(html):
        t = time.process_time()
        pages.main_text(html)
        return time.process_time() - t

    for page in (lambda n: "<div>" * n + "a" + "</div>" * n, lambda n: "<body>" + "<div>a b c" * n, lambda n: "<body>" + "".join(f"<p>{'word ' * (i % 40)}</p><ul><li><a href=x>l</a></ul>" for i in range(n))):
        assert seconds(page(8000)) < 8 * seconds(page(2000)) + 0.5


class RunTagger:
    """Tags every run of anything but spaces as an e-mail."""

    def decode(self, codes):
        inside = (codes != 32) & (codes != 130)
        begin = inside & ~np.pad(inside, ((0, 0), (1, 0)))[:, :-1]
        return np.where(begin, 1, np.where(inside, 2, 0)).astype(np.int8), np.full(codes.shape, 2.0)


@pytest.mark.parametrize("length", [20, 31, 32, 40, 62, 63, 64, 65, 150, 1000])
def test_tagged_spans_of_any_length_and_alignment(length):
    for at in range(1, 66):
        for left in {1, length // 2, length - 2}:
            text = " " * at + "é" * left + "@" + "x" * (length - left - 1) + " end of it, and more words to follow here"
            assert pii.tagged_spans([text, text.strip()], RunTagger()) == [[(at, at + length, "email")], [(0, length, "email")]], (at, left)


def test_training_contexts_come_from_whole_texts_with_numbers(spark):
    body = " ".join(f"word{i}" if i % 3 else f"in {1900 + i % 100}" for i in range(4000))
    rows = [(i, body) for i in range(40)] + [(100, None), (101, ""), (102, "short 12"), (103, "mail a.b@c.org or 4417 7442 8035 1547 in 2001"), (104, body + " call +1 212 555 0198 now")]
    got, own = pii.contexts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert (got, own) == pii.contexts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    where = sorted(body.index(c) for c in got if len(c) == pii.STRETCH and c in body)
    assert "short 12" in got and len(where) > 250 and where[0] < 2000 and where[-1] > 0.9 * len(body) and sum(w > 2000 for w in where) > 0.8 * len(where)
    assert all(any(ch.isdigit() for ch in pii.masked(c)) for c in got if len(c) == pii.STRETCH)
    assert pii.masked(rows[-2][1]).split() == ["mail", "or", "in", "2001"]
    assert len(own) == 2 and rows[-2][1] in own and all(pii.base_spans(c) for c in own)


# the contract's patterns, as they stand there
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def by_the_contract(text):
    out = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            luhn = sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_personal_data_equals_the_contracts_patterns(spark):
    r = random.Random(8)
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6 + i, "".join(r.choice(["a", "é", ".", "@", "-", "+", " ", "(", ")", "1", "4", "25", "0", "\n", "4417 7442 8035 1547", "+1 212 555 0198", "10.0.0.1", "x@y.org"]) for _ in range(r.randint(0, 60)))) for i in range(1500)]
    rows += [(7, None), (8, ""), (9, "z@a.bc " * 20_000), (9, "z@a.bc " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("n_ip", F.lit(None))
    got = sorted(tuple(x) for x in pii.find_personal_data(df).drop("spans").collect())
    want = []
    for i, t in rows:
        found = by_the_contract(t or "")
        want.append((i, *(sum(f.startswith(k + ":") for f in found) for k in PATTERNS), hashlib.sha256(",".join(found).encode()).hexdigest()))
    assert got == sorted(want)


def test_tagger_finds_rewritten_spans_of_texts_it_has_not_seen(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    plain, own = pii.contexts(d.where("doc_id % 2 = 0"))
    tagger, rng = pii.trained(plain, own), np.random.default_rng(7)
    hit, total, clean = defaultdict(int), defaultdict(int), 0
    for x in d.where("doc_id % 2 = 1").collect():
        base = pii.base_spans(x["text"] or "")
        if base:
            lo, hi, kind = base[0]
            span = pii.rewritten(rng, kind, x["text"][lo:hi])
            text = x["text"][max(0, lo - 100) : lo] + span + x["text"][hi : hi + 100]
            total[kind] += 1
            hit[kind] += any(k == kind and b > min(lo, 100) and a < min(lo, 100) + len(span) for a, b, k in pii.tagged_spans([text], tagger)[0])
        elif x["text"]:
            clean += len(pii.tagged_spans([x["text"]], tagger)[0])
    assert all(hit[k] >= 0.6 * total[k] > 20 for k in pii.KINDS), (dict(hit), dict(total))
    assert clean <= 5


def test_near_duplicate_stage_keeps_every_text_of_a_shared_doc_id(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(words(80, 20 + i)) for i in range(4))
    near = a.split()
    near[40] = "changed"
    rows = [(1, a, "en", "x"), (1, b, "en", "x"), (1, b, "en", "w"), (1, " ".join(near), "en", "x"), (2, c, "en", "x"), (3, c, "en", "x"), (3, d, "en", "x"), (4, None, "en", "x"), (4, "", "en", "x"), (None, a, "en", "x"), (5, b, "en", "x")]
    for n in (1, 3, 7):
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).repartition(n)
        got = sorted(map(tuple, corpus_pipeline.near_duplicate_stage(spark, df, "").collect()), key=repr)
        assert sorted(t[1] for t in got if t[0] == 1 and t[1] != b) in ([a], [" ".join(near)])
        assert [t for t in got if t[1] == b] in ([(1, b, "en", "w", len(b))], [(5, b, "en", "x", len(b))])
        assert [t[0] for t in got if t[1] == c] in ([2], [3]) and [t[0] for t in got if t[1] == d] == [3]
        assert [t[1] for t in got if t[0] == 4 and t[1] != ""] == [None] and (4, "", "en", "x", 0) in got and (None, a, "en", "x", len(a)) in got
        assert len(got) == 7
        assert n == 1 or got == first
        first = got


def test_curves_recall_of_the_registered_query_on_the_largest_table(spark):
    from pathlib import Path

    from tidemark.llm import queries

    folder = next(f for f in ("/root/testdata/check_l", "/root/testdata/check_s", "/root/testdata/sf0.1") if Path(f, "embeddings.parquet").exists())
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    got = defaultdict(set)
    for r in queries.op5_nearest_neighbours(spark, folder).select("query_id", "vec_id").collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        away = ((x - x[q]) ** 2).sum(1)
        away[ids == ids[q]] = np.inf
        best = set(ids[np.argsort(away, kind="stable")[:10]].tolist())
        hit += len(best & got[int(ids[q])])
        total += len(best)
    assert hit >= 0.9 * total


PAGES_WITH_TAGS_LEFT_OUT = (
    ("<!doctype html><html><head><title>T</title><article><p>One.</p><p>Two.</p></article>", ["One.", "Two."]),
    ("<html><head><meta charset=x>Hello there<p>Two", ["Hello there", "Two"]),
    ("<head><script>x</script><noscript><iframe src=y></iframe></noscript></head><p>One", ["One"]),
    ("<article><p>One</p><svg><path d=1><p>Two</p></article><p>Three", ["One", "Two", "Three"]),
    ("<article><p>One</p><button>Share<p>Two</p></article><p>Three", ["One", "Two", "Three"]),
    ("<article><p>One <button>Share</p><p>Two</p></article>", ["One", "Two"]),
    ("<article><p>One<svg><title>icon</title><foreignObject><div>in</div></foreignObject></svg> more</p></article>", ["One more"]),
    ("<article><button><div>Share</div></button><p>Two</p></article>", ["Two"]),
    ("<p>a<select><option>x<option>y</select>b</p>", ["a b"]),
    ("<div><iframe></div>x</iframe>y</div>", ["y"]),
    ("<svg/><p>ok<svg></svg>k</p>", ["ok k"]),
    ("<!-- <button> --><p>One <button>go</button> two</p>", ["One two"]),
)


@pytest.mark.parametrize("html, want", PAGES_WITH_TAGS_LEFT_OUT)
def test_pages_lose_no_text_where_tags_are_left_out(html, want):
    assert [b[0] for b in pages.read(html)] == want


def test_repeats_chunk_costs_the_same_whatever_the_number_of_buckets():
    import time

    import pyarrow as pa

    text = " ".join(words(40_000, 77)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], names=["doc_id", "text"])
    rows, took = {}, {}
    for buckets in (100_000, 100_000_000):
        began = time.process_time()
        rows[buckets] = sum(b.num_rows for b in repeats._edges_of(20, buckets)(iter([batch])))
        took[buckets] = time.process_time() - began
    assert rows[100_000_000] <= 40_000 and took[100_000_000] < 3 * took[100_000] + 1


def test_empty_documents_table(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs.limit(0), labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == docs.count()


def test_personal_data_in_a_long_text_full_of_hints(spark):
    base = "write to ann.b1@mail.example.org, +1 212 555 0198 or 10.0.0.7 dot 3 @ 4 "
    text = base * 8_000
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    assert (got[1]["n_email"], got[1]["n_phone"], got[1]["n_ip"]) == (8_000, 8_000, 8_000)
    assert got[2]["spans"] == got[3]["spans"] == ""


def test_near_duplicates_send_no_table_that_grows_through_the_driver(spark, docs, monkeypatch):
    """Small files look small enough to be broadcast, whatever an explode makes of them: only the bitmap of ids, which has a bound, may be."""
    import corpus_pipeline

    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.stage(df)

    for m in (sketches, components, corpus_pipeline):
        monkeypatch.setattr(m, "stage", planned)
    planned(corpus_pipeline.near_duplicate_stage(spark, docs, ""))
    planned(sketches.near_duplicates(docs))
    sent = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert len(plans) > 20 and all("[word#" in line for line in sent)
