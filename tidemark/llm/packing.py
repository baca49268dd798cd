"""Packing tokenized documents into sequences by the dot-product heuristic for vector bins.

A piece of a document asks for tokens, one segment and its loss-bearing tokens; a sequence has a limit for each. The open
sequence takes, of a pool of pieces, the one that fits and whose demand has the largest dot product with what is left; when none
fits, that of which most fits is cut to fill the sequence. Each task packs its own documents with a bounded pool; what a task
has left over at its end is cut at powers of two, so that it needs no padding either.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, columns, rows_out, texts

#: Limits of a sequence: ids, pieces, loss-bearing ids (15/16 of the ids: some of every full sequence are prompts).
TOKENS, SEGMENTS, LOSS = 4096, 512, 3840
END_ID = 2
_POOL = 512
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: A mark behind an ASCII letter or a Latin letter up to U+024F (not the signs U+00D7, U+00F7, and not U+0130, whose
#: lower case ends in a mark): the splitting rule ends a piece between them.
_MARK = re.compile(rb"[.,;:!?#$%&*|](?:(?<=[a-z].)|(?<=[\xc4-\xc9][\x80-\xbf].)(?<!\xc4\xb0.)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
#: The letter that byte-level vocabularies write for each byte: itself where it prints, else the next one from U+0100.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = {**{b: b for b in _PRINTS}, **{b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTS)}}


class _Encoder:
    """Ids (little-endian uint32) of texts. The tokenizer never joins text over white space, so words are
    encoded once and remembered; the memory is bounded and outlives a task."""

    LIMIT = 1_000_000

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        """Latin letters are one piece in normal form once they are of one case, so the merges alone are left to do."""
        letters, codes, rest = [], [], []
        for w in words:
            if w.isalpha() and w.islower():  # ASCII
                letters.append(w)
                codes.append(w.decode())
                continue
            text = w.decode()
            if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
                letters.append(w)
                codes.append(text.lower().encode().decode("latin-1").translate(_LETTER))
            else:
                rest.append(w)
        merge = self.tokenizer.model.tokenize
        split = [[t.id for t in merge(c)] for c in codes]
        raw, at = np.fromiter(chain.from_iterable(split), "<u4").tobytes(), 0
        known = self.words
        for w, ids in zip(letters, split, strict=True):
            end = at + 4 * len(ids)
            known[w] = raw[at:end]
            at = end
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()

    def words_of(self, text: bytes) -> list[bytes]:
        """Pieces that the tokenizer encodes each by itself: ASCII white space ends every match of its splitting rule, which also
        parts letters from marks; case does not count. A special token's string is that token, and stays as it is."""
        return text.split() if b"<|" in text else _MARK.sub(rb" \g<0>", text.lower()).split()

    def encode(self, some: list[bytes]) -> list[bytes]:
        split = [self.words_of(t) for t in some]
        if len(self.words) > self.LIMIT:
            self.words.clear()
        if new := set().union(*split).difference(self.words):
            self._learn(list(new))
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


@lru_cache(maxsize=2)
def _encoder(path: str | None) -> _Encoder:
    return _Encoder(path)


class Packer:
    """Pieces in, closed sequences out. limits: tokens, segments, loss-bearing tokens."""

    def __init__(self, limits: tuple[int, int, int], first_id: int = 0):
        self.limits = np.array(limits, float)
        self.next_id = first_id
        #: doc, ids, start, end, first loss-bearing position
        self.items: list[tuple] = []
        self.demand = np.empty((_POOL, 3))
        self.closed = Counter()

    def _ask(self, item: tuple) -> tuple[int, int, int]:
        return item[3] - item[2], 1, max(0, item[3] - max(item[2], item[4]))

    def _fits(self, item: tuple, room: np.ndarray) -> int:
        """The longest part, from its start, that room holds."""
        free = max(0, item[4] - item[2])
        return int(min(item[3] - item[2], room[0], free + room[2]))

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        """Rows of one closed sequence; one that isn't full goes into sequences of powers of two."""
        total = sum(p[3] - p[2] for p in pieces)
        sizes = [total] if total == self.limits[0] else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        rows, at = [], 0
        doc, ids, lo, hi, _ = pieces[0]
        for size in sizes:
            offset = 0
            while offset < size:
                if lo == hi:
                    at += 1
                    doc, ids, lo, hi, _ = pieces[at]
                n = min(hi - lo, size - offset)
                rows.append((doc, lo, n, ids[4 * lo : 4 * (lo + n)], len(ids) // 4, self.next_id, offset))
                offset += n
                lo += n
            self.next_id += 1
        return rows

    def _close_one(self) -> list[tuple]:
        """Fill one sequence. What closes it is counted in `closed`: no room for tokens, segments or loss-bearing tokens, or no pieces left."""
        room, chosen, n = self.limits.copy(), [], len(self.items)
        demand = self.demand[:n]
        scaled = demand / self.limits
        out = np.zeros(n, bool)  # taken, or cut once already
        stay = np.ones(n, bool)
        while room[0] > 0 and room[1] > 0:
            score = np.where(out | (demand > room).any(1), -1.0, scaled @ (room / self.limits))
            best = int(score.argmax())
            if score[best] >= 0:
                chosen.append(self.items[best])
                room -= demand[best]
                out[best], stay[best] = True, False
                continue
            # none fits whole: the one of which most fits is cut
            part = np.where(out, 0, np.minimum(np.minimum(demand[:, 0], room[0]), demand[:, 0] - demand[:, 2] + room[2]))
            best = int(part.argmax())
            size = int(part[best])
            if size <= 0:
                break
            doc, ids, lo, hi, loss_from = self.items[best]
            head = (doc, ids, lo, lo + size, loss_from)
            chosen.append(head)
            room -= self._ask(head)
            out[best] = True
            self.items[best] = (doc, ids, lo + size, hi, loss_from)
            demand[best] = self._ask(self.items[best])
        self.closed[next((name for name, left in zip(("tokens", "segments", "loss"), room, strict=True) if left <= 0), "end")] += 1
        kept = np.flatnonzero(stay)
        self.items = [self.items[i] for i in kept]
        self.demand[: len(kept)] = demand[kept]
        return self._sequence(chosen)

    def add(self, doc, ids: bytes, loss_from: int = 0) -> list[tuple]:
        rows, lo, n = [], 0, len(ids) // 4
        while lo < n:
            part = self._fits((doc, ids, lo, n, loss_from), self.limits)
            item = (doc, ids, lo, lo + part, loss_from)
            lo += part
            if part == self.limits[0]:
                self.closed["tokens"] += 1
                rows += self._sequence([item])
                continue
            self.demand[len(self.items)] = self._ask(item)
            self.items.append(item)
            if len(self.items) == _POOL:
                rows += self._close_one()
        return rows

    def close(self) -> list[tuple]:
        rows = []
        while self.items:
            rows += self._close_one()
        return rows


def pack(docs: DataFrame, tokenizer_path: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS) -> DataFrame:
    """doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset: one row a piece.

    Every document is its ids and END_ID; null and empty texts are END_ID alone. The first of several lines is the
    prompt: its ids bear no loss, all others do (a text of one line is all answer). Each id lies in exactly one piece; sequences hold
    at most `tokens`, `segments` and `loss`, without gaps; one shorter than `tokens` is a power of two long.
    Rows that repeat a doc_id are packed each by itself. Texts of any length are encoded whole; one longer than a limit gives several
    pieces. sequence_id is the task's number and a count. An empty table gives no rows. Other columns play no part.
    """

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        encoder, packer = _encoder(tokenizer_path), Packer((tokens, segments, loss), TaskContext.get().partitionId() << 32)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, raw = columns(batch, "doc_id", "text")
            for at in range(0, len(ids), 200):
                some = [t or b"" for t in raw[at : at + 200]]
                prompts = [len(c) // 4 for c in encoder.encode([t[: max(0, t.find(b"\n"))] for t in some])]
                rows: list[tuple] = []
                for doc, code, prompt in zip(ids[at : at + 200], encoder.encode(some), prompts, strict=True):
                    rows += packer.add(doc, code + end, prompt)
                if rows:
                    yield rows_out(_OUT, *zip(*rows, strict=True))
        rows = packer.close()
        for at in range(0, len(rows), 5000):
            yield rows_out(_OUT, *zip(*rows[at : at + 5000], strict=True))

    return texts(docs).mapInArrow(run, _DDL)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
