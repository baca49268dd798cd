"""Substring dedup: windows of words that occur earlier in the corpus are removed.

A window of ``size`` words is an edge of the corpus's De Bruijn graph. Only repeated edges matter.

1. Each task hashes its windows, keeps the first local occurrence of each edge and reports the other
   local ones as spans right away (a passage that is everywhere leaves a task once).
2. Kept edges travel by minimizer (least hash of the shorter k-mers in the window): neighbouring
   windows nearly always share it, so they travel as one run: bucket, coordinates of the run, 8 bytes a window.
3. In a bucket each edge with several occurrences points to its earliest one. Runs of edges whose
   sources also follow one another are one piece of a path; an edge goes by the coordinates of its source.
4. Compaction: pieces that follow one another in some document are joined by an arc. Where the piece behind has no other
   successor and the piece ahead no other predecessor, and their sources are in step, the arc does not branch; pointer doubling
   over such arcs gives each piece the head of its path, and a document's pieces on one path are one span.
5. Source coordinates are looked up: the words of each source span are digested from the source's
   text, and a document drops a span only if its own words give the same digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, columns, rows_out, shuffle_partitions, stage, texts, window_hashes, word_hashes

SIZE = 20
_CHUNK = 1_200_000
_EDGES = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_SPANS = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("src", pa.int64()), ("src_start", pa.int32())])
_SPAN_DDL = "doc long, start int, n int, src long, src_start int"


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays as bytes; whole numbers as differences, for they are in order and nearly alike."""
    out = [np.array([len(a) for a in arrays], np.uint32).tobytes()]
    for a in arrays:
        out.append((a if a.dtype.kind == "u" else np.diff(a, prepend=a.dtype.type(0))).tobytes())
    return _zip(out)


def _zip(parts: list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.uint32, len(kinds))
    at, out = 4 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        a = np.frombuffer(raw, kind, int(n), at)
        at += a.nbytes
        out.append(a if a.dtype.kind == "u" else np.cumsum(a, dtype=a.dtype))
    return out


#: minimizer, document, start, windows (one entry a run), check (one a window): an edge goes by minimizer and check, 128 bits in all
_KINDS = (np.uint64, np.int64, np.int32, np.uint8, np.uint64)
#: Bytes of text that a bucket stands for: their number grows with the input, so that a bucket does not.
_BUCKET = 4 << 20
_TASK = 48 << 20


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours."""
    have, span, n = h, 1, len(h) - width + 1
    while 2 * span <= width:
        have = np.minimum(have[: len(have) - span], have[span:])
        span *= 2
    return np.minimum(have[:n], have[width - span : width - span + n])


def _first_of(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For entries in `order` (equal keys together, earliest first): index of the first of each entry's group."""
    same = np.ones(len(order), bool)
    same[0] = False
    for k in keys:
        s = k[order]
        same[1:] &= s[1:] == s[:-1]
    heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    first = np.empty(len(order), np.int64)
    first[order] = order[heads]
    return first


def _runs(doc: np.ndarray, start: np.ndarray, src: np.ndarray, src_start: np.ndarray) -> list[np.ndarray]:
    """Single edges, in order of (doc, start), as paths of consecutive edges with consecutive sources."""
    if not len(doc):
        return [doc, start, start, src, src_start]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (src[1:] != src[:-1]) | (src_start[1:] != src_start[:-1] + 1)
    at = np.flatnonzero(new)
    return [doc[at], start[at], np.diff(at, append=len(doc)).astype(np.int32), src[at], src_start[at]]


def _edges_of(size: int, buckets: int):
    k = max(1, size // 2)

    def emit(docs: list, hashes: list):
        order = sorted(range(len(docs)), key=docs.__getitem__)
        n = np.array([len(hashes[i]) - size + 1 for i in order])
        doc = np.repeat(np.array([docs[i] for i in order], np.int64), n)
        start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        edge = np.concatenate([window_hashes(hashes[i], size) for i in order])
        least = np.concatenate([_least(window_hashes(hashes[i], k), size - k + 1) for i in order])
        # a stable sort keeps (doc, start) order among equal edges
        first = _first_of(np.argsort(edge, kind="stable"), edge, least)
        # rows that repeat a doc_id tie; only an earlier document or start counts
        late = (doc[first] < doc) | (start[first] < start)
        at = np.flatnonzero(late)
        spans = _runs(doc[at], start[at], doc[first[at]], start[first[at]])
        at = np.flatnonzero(~late)
        doc, start, least, check = doc[at], start[at], least[at], edge[at]
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (least[1:] != least[:-1])
        head = np.flatnonzero(new)
        length = np.diff(head, append=len(at))
        if (long := length > 255).any():  # loops of one passage: cut, a run's length is one byte
            cut = np.concatenate([np.arange(h, h + m, 255) for h, m in zip(head[long], length[long], strict=True)])
            head = np.union1d(head, cut)
            length = np.diff(head, append=len(at))
        bucket = (least[head] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        # the buckets that this chunk has runs for: work and rows grow with the chunk, not with the number of buckets
        ids, bounds = np.unique(bucket[by], return_index=True)
        ids, blobs = ids.tolist(), []
        for r in np.split(by, bounds[1:]) if ids else ():
            m = length[r]
            w = np.repeat(head[r] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            blobs.append(_packed([least[head[r]], doc[head[r]], start[head[r]], m.astype(np.uint8), check[w]]))
        if len(spans[0]):
            ids.append(-1)
            blobs.append(_zip([np.array([len(spans[0])], np.uint32).tobytes(), *(a.tobytes() for a in spans)]))
        return rows_out(_EDGES, ids, blobs)

    def edges(batches: Batches) -> Batches:
        docs, hashes, count = [], [], 0
        for batch in batches:
            for doc, text in zip(*columns(batch, "doc_id", "text"), strict=True):
                h = word_hashes(text.split()) if text and doc is not None else ()
                if len(h) < size:
                    continue
                docs.append(doc)
                hashes.append(h)
                count += len(h)
                if count >= _CHUNK:
                    yield emit(docs, hashes)
                    docs, hashes, count = [], [], 0
        if docs:
            yield emit(docs, hashes)

    return edges


def _bucket_paths(table: pa.Table) -> pa.Table:
    """One bucket (or local spans, which pass): late occurrences as paths."""
    import zstandard

    blobs = table.column("blob").to_pylist()
    if table.column("bucket")[0].as_py() < 0:
        parts = []
        for blob in blobs:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n, at, cols = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
            for f in _SPANS:
                a = np.frombuffer(raw, f.type.to_pandas_dtype(), n, at)
                at += a.nbytes
                cols.append(a)
            parts.append(cols)
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    else:
        parts = [_unpacked(b, _KINDS) for b in blobs]
        least, doc, start, n, check = (np.concatenate(c) for c in zip(*parts, strict=True))
        n = n.astype(np.int64)
        offset = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        least, doc, start = np.repeat(least, n), np.repeat(doc, n), np.repeat(start, n) + offset
        # drop single edges before the full sort
        key = least * np.uint64(0x9E3779B97F4A7C15) + check
        s = np.sort(key)
        again = np.unique(s[1:][s[1:] == s[:-1]])
        at = np.searchsorted(again, key) if len(again) else np.empty(0, int)
        at = np.flatnonzero(again[np.minimum(at, len(again) - 1)] == key) if len(again) else at
        least, doc, start, check = least[at], doc[at], start[at], check[at]
        if not len(at):
            return _SPANS.empty_table()
        order = np.lexsort((start, doc, check, least))
        first = _first_of(order, least, check)
        at = np.flatnonzero((doc[first] < doc) | (doc[first] == doc) & (start[first] < start))
        at = at[np.lexsort((start[at], doc[at]))]
        cols = _runs(doc[at], start[at], doc[first[at]], start[first[at]])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SPANS, strict=True)], schema=_SPANS)


def _volume(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _tasks(docs: DataFrame, volume: int) -> int:
    """Partitions of a shuffle that carries the texts or their edges: the session's, or more if each would hold over _TASK bytes of text."""
    return max(shuffle_partitions(docs.sparkSession), -(-volume // _TASK))


def pieces(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc, start, n, src, src_start: n consecutive windows of doc, from word start, whose words also start
    earlier, at src_start of document src. Not yet compacted nor checked against the text."""
    spark = docs.sparkSession
    volume = _volume(docs)
    buckets = max(8 * shuffle_partitions(spark), -(-volume // _BUCKET))
    edges = texts(docs).mapInArrow(_edges_of(size, buckets), "bucket int, blob binary")
    # local spans (bucket -1) are dealt out by salt
    salt = F.when(F.col("bucket") < 0, F.abs(F.xxhash64("blob")) % buckets).otherwise(0)
    return edges.withColumn("salt", salt).repartition(_tasks(docs, volume), "bucket", "salt").groupBy("bucket", "salt").applyInArrow(_bucket_paths, _SPAN_DDL)


def arcs(found: DataFrame) -> DataFrame:
    """src, src_start, n (a piece) and n_ahead (of the piece ahead, whose source is in step) of arcs that do not branch."""
    here = found.select("doc", (F.col("start") + F.col("n")).alias("at"), *(F.col(c).alias(f"a_{c}") for c in ("src", "src_start", "n")))
    ahead = found.select("doc", F.col("start").alias("at"), *(F.col(c).alias(f"b_{c}") for c in ("src", "src_start", "n")))
    arc = here.join(ahead, ["doc", "at"]).drop("doc", "at").distinct()
    a, b = ["a_src", "a_src_start", "a_n"], ["b_src", "b_src_start", "b_n"]
    out = arc.groupBy(*a).agg(F.count("*").alias("out"), F.first(F.struct(*b)).alias("ahead")).where("out = 1")
    single = arc.groupBy(*b).agg(F.count("*").alias("into")).where("into = 1")
    straight = out.where("ahead.b_src = a_src and ahead.b_src_start = a_src_start + a_n").select(*a, "ahead.*")
    return straight.join(single.drop("into"), b).select(F.col("a_src").alias("src"), F.col("a_src_start").alias("src_start"), F.col("a_n").alias("n"), F.col("b_n").alias("n_ahead"))


def heads(found: DataFrame) -> DataFrame:
    """src, src_start, n, head, head_n: the piece at the head of each piece's path, for pieces that have one before them.

    Pointers double: each round every piece takes its pointer's pointer, so a path of m pieces needs log2(m) rounds.
    """
    now = stage(arcs(found).select("src", (F.col("src_start") + F.col("n")).alias("src_start"), F.col("n_ahead").alias("n"), F.col("src_start").alias("head"), F.col("n").alias("head_n")))
    while True:
        up = now.select("src", F.col("src_start").alias("head"), F.col("n").alias("head_n"), F.col("head").alias("higher"), F.col("head_n").alias("higher_n"))
        step = stage(now.join(up, ["src", "head", "head_n"], "left").select("src", "src_start", "n", F.coalesce("higher", "head").alias("head"), F.coalesce("higher_n", "head_n").alias("head_n"), F.col("higher").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def paths(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc, start, n, src, src_start, as pieces() gives them, with the pieces of a document that lie on one path joined."""
    found = stage(pieces(docs, size))
    placed = found.join(heads(found), ["src", "src_start", "n"], "left").withColumn("head_n", F.coalesce("head_n", "n")).withColumn("head", F.coalesce("head", "src_start"))
    one = F.struct("start", "n", "src_start").alias("p")
    runs = placed.groupBy("doc", "src", "head", "head_n", (F.col("start") - F.col("src_start")).alias("ahead")).agg(
        F.min(one).alias("first"), F.sum("n").cast("int").alias("n"), (F.max(F.col("start") + F.col("n")) - F.min("start")).alias("reach"), F.collect_list(one).alias("parts")
    )
    # a document that leaves a path and comes back to it keeps its pieces apart
    whole = F.array(F.struct(F.col("first.start").alias("start"), "n", F.col("first.src_start").alias("src_start")))
    return runs.select("doc", "src", F.explode(F.when(F.col("n") == F.col("reach"), whole).otherwise(F.col("parts"))).alias("p")).select("doc", "p.start", "p.n", "src", "p.src_start")


def _digest(words: list[bytes], start: int, n: int, size: int) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words[start : start + n + size - 1]))


def _source_digests(size: int):
    out = pa.schema([("src", pa.int64()), ("src_start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])

    def digests(batches: Batches) -> Batches:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for doc, text, wanted in zip(*columns(batch, "doc_id", "text", "wanted"), strict=True):
                words = text.split() if text else []
                for x in wanted:
                    for c, v in zip(cols, (doc, x["src_start"], x["n"], _digest(words, x["src_start"], x["n"], size)), strict=True):
                        c.append(v)
            yield rows_out(out, *cols)

    return digests


def _kept(size: int):
    out = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def kept(batches: Batches) -> Batches:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, text, spans in zip(*columns(batch, "doc_id", "text", "spans"), strict=True):
                words = text.split() if text else []
                total = len(words)
                if spans:
                    gone = np.zeros(total + 1, np.int32)
                    for s in spans:
                        if s["start"] + s["n"] + size - 1 <= total and _digest(words, s["start"], s["n"], size) == s["digest"]:
                            gone[s["start"]] += 1
                            gone[s["start"] + s["n"] + size - 1] -= 1
                    stay = np.cumsum(gone[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                left = b" ".join(words)
                for c, v in zip(cols, (doc, left, total, total - len(words), hashlib.sha256(left).hexdigest()), strict=True):
                    c.append(v)
            yield rows_out(out, *cols)

    return kept


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, kept (UTF-8 words left, joined by one space), n_words, n_removed, kept_sha256.

    A word goes if a window of `size` words that covers it also starts earlier: in a document of smaller
    doc_id, or earlier in its own. Null and empty texts have no words. Documents shorter than a window keep
    all. Rows with a null doc_id have no place in the order: they keep all their words and are no source.
    Rows that repeat a doc_id count as one place: they are not removed against each other, and a
    span goes from those of them that hold its words. Texts of any length are read whole; an empty table gives no rows; other columns of
    docs play no part.
    """
    rows = texts(docs)
    # dealt out once: both joins below read the same exchange
    placed = rows.where(F.col("doc_id").isNotNull()).repartition(_tasks(docs, _volume(docs)), "doc_id")
    found = stage(paths(docs, size))
    wanted = found.select("src", "src_start", "n").distinct().groupBy("src").agg(F.collect_list(F.struct("src_start", "n")).alias("wanted"))
    digests = placed.join(wanted, placed["doc_id"] == wanted["src"]).select("doc_id", "text", "wanted").mapInArrow(_source_digests(size), "src long, src_start int, n int, digest binary").distinct()
    spans = found.join(digests, ["src", "src_start", "n"]).groupBy("doc").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans"))
    whole = placed.join(spans, placed["doc_id"] == spans["doc"], "left").select("doc_id", "text", "spans")
    loose = rows.where(F.col("doc_id").isNull()).withColumn("spans", F.lit(None).cast(whole.schema["spans"].dataType))
    return whole.unionByName(loose).mapInArrow(_kept(size), "doc_id long, kept binary, n_words long, n_removed long, kept_sha256 string")
