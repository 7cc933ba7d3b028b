"""Best-fit packing: documents become pieces of at most `capacity` tokens, which fill sequences of that size.

A document is its token ids and one end id. Pieces are packed shard by shard, a shard holding a bounded number of
pieces chosen by hash, so a task never sees more. A shard starts with every piece in a sequence of its own. A local
search then works on the sequences that still have room, from the fullest to the emptiest: it moves a piece, exchanges
one for one, or two for one, always taking the exchange that raises the fuller sequence most. Each step raises the sum
of squared fills, so the search ends, and emptied sequences disappear. All exchanges look at all lengths in the shard.
Two for one is tried where the others leave a gap; its two pieces may come from two sequences. It spends small pieces,
so a first pass does without, and passes with it follow until one changes nothing.

Defined cases: a null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed one by
one; a text of any length is cut into full pieces and a shorter last one; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, cut, tidied

CAPACITY = 2048
END_ID = 0
SHARD_PIECES = 40_000
VOCABULARY = "word_bpe_49k.json"


#: A blank-free chunk of Latin letters and end marks: the letters are one word to the vocabulary, the marks another.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]*)")


class ChunkIds(dict):
    """Blank-free chunk of UTF-8 -> its ids as little-endian uint32; the vocabulary never joins across blanks.

    Unknown chunks are learnt many at once: plain words are encoded as one text and told apart by the ids that end a
    word, everything else is encoded chunk by chunk.
    """

    def __init__(self, tokenizer, limit: int = 350_000):
        super().__init__()
        self.tokenizer, self.limit = tokenizer, limit
        self.parts: dict[str, bytes] = {}
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        for piece, i in tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            (ids,) = self._encode([" ".join(part)])
            cuts = 4 * (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1)
            if len(cuts) == len(part):
                self.parts.update(zip(part, (ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)), strict=True))
            else:
                self.parts.update(zip(part, self._encode(part), strict=True))

    def learn(self, chunks: set[bytes]) -> None:
        if len(self) + len(chunks) > self.limit:
            self.clear()
        if len(self.parts) > self.limit // 2:
            self.parts.clear()
        texts = [c.decode("utf-8", "replace") for c in chunks]
        plain = [_PLAIN.fullmatch(t) for t in texts]
        self._learn_words(list({w for m in plain if m for w in (m[1].lower(), m[2]) if w} - self.parts.keys()))
        odd = [c for c, m in zip(chunks, plain, strict=True) if not m]
        for i in range(0, len(odd), 5_000):  # the library's results are much larger than the ids
            self.update(zip(odd[i : i + 5_000], self._encode([c.decode("utf-8", "replace") for c in odd[i : i + 5_000]]), strict=True))
        parts = self.parts
        for c, m in zip(chunks, plain, strict=True):
            if m:
                self[c] = parts[m[1].lower()] + parts[m[2]] if m[2] else parts[m[1].lower()]


@lru_cache(maxsize=1)
def _known_chunks(path: str) -> ChunkIds:
    """One memory a Python worker: it outlives a task, its size is bounded."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
    from tokenizers import Tokenizer

    return ChunkIds(Tokenizer.from_file(path))


REMEMBERED["packing"] = _known_chunks.cache_clear


def encoder(path: str, limit: int = 350_000, most_words: int = 300_000):
    """texts (UTF-8 or None) -> ids as bytes, by the public vocabulary file; limit chunks are known, most_words in hand."""
    known = _known_chunks(path)
    known.limit = limit

    def encode(texts: list[bytes | None]):
        at = 0
        while at < len(texts):
            found, gaps, fresh, n_words = [], [], set(), 0
            while at < len(texts) and n_words < most_words:
                chunks = texts[at].split() if texts[at] else []
                ids = list(map(known.get, chunks))
                gap, i = [], -1
                try:
                    while True:
                        i = ids.index(None, i + 1)
                        gap.append((i, chunks[i]))
                except ValueError:
                    pass
                fresh.update([c for _, c in gap])
                found.append(ids)
                gaps.append(gap)
                n_words += len(chunks)
                at += 1
            known.learn(fresh)
            for ids, gap in zip(found, gaps, strict=True):
                for i, c in gap:
                    ids[i] = known[c]
                yield b"".join(ids)

    return encode


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, remember: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; no shuffle. Workers remember chunks for their next task, or not."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encode = encoder(vocabulary) if remember else encoder(vocabulary, 120_000, 60_000)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            texts = (text for i in range(0, len(b), 500) for text in encode(b.column(1).slice(i, 500).to_pylist()))
            for i, ids in enumerate(texts):
                ids += end
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(tidied(run, "packing" if remember else ""), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _Pool:
    """The sequences that still have room: which of them hold a piece of a given length."""

    def __init__(self):
        self.where: dict[int, dict[int, None]] = defaultdict(dict)
        self.mask = 0

    def add(self, size: int, at: int) -> None:
        self.where[size][at] = None
        self.mask |= 1 << size

    def remove(self, size: int, at: int) -> None:
        holders = self.where[size]
        del holders[at]
        if not holders:
            self.mask ^= 1 << size

    def longest(self, most: int) -> int:
        """Greatest length at most `most` in the pool, 0 if none."""
        return (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.mask & ((1 << (most + 1)) - 1) else 0

    def two(self, most: int, least: int) -> tuple[int, int] | None:
        """Two lengths p >= q in the pool with the greatest sum over `least` that is at most `most`; equal ones have two holders."""
        best, p = None, self.longest(most - 1)
        while 2 * p > least:
            q = self.longest(min(p, most - p))
            if q == p and len(self.where[p]) < 2:
                q = self.longest(p - 1)
            if q and p + q > least:
                best, least = (p, q), p + q
                if least == most:
                    break
            p = self.longest(p - 1)
        return best


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over the underfull bins: a pass without two-for-one exchanges, then passes with them."""

    def square(bins):
        return sum(sum(lengths[i] for i in items) ** 2 for items in bins)

    bins = _pass(bins, lengths, capacity, False)
    have = square(bins)
    while True:
        bins = _pass(bins, lengths, capacity, True)
        if (now := square(bins)) == have:
            return bins
        have = now


def _pass(bins: list[list[int]], lengths: list[int], capacity: int, pairs: bool) -> list[list[int]]:
    """Every underfull bin once; every step raises the squared fill, so there are never more bins."""
    sizes = [defaultdict(list) for _ in bins]
    fill = [0] * len(bins)
    for at, items in enumerate(bins):
        for i in items:
            sizes[at][lengths[i]].append(i)
            fill[at] += lengths[i]
    pool = _Pool()
    heap = []
    for at in range(len(bins)):
        if fill[at] < capacity:
            heap.append((-fill[at], at))
            for s in sizes[at]:
                pool.add(s, at)
    heapq.heapify(heap)

    def take(at: int, size: int, pooled: bool) -> int:
        i = sizes[at][size].pop()
        if not sizes[at][size]:
            del sizes[at][size]
            if pooled:
                pool.remove(size, at)
        fill[at] -= size
        return i

    def put(at: int, size: int, item: int, pooled: bool) -> None:
        if pooled and size not in sizes[at]:
            pool.add(size, at)
        sizes[at][size].append(item)
        fill[at] += size

    open_bins = {at for _, at in heap}
    while heap:
        f, b = heapq.heappop(heap)
        if b not in open_bins:
            continue
        if -f != fill[b]:
            if fill[b]:
                heapq.heappush(heap, (-fill[b], b))
            else:
                open_bins.discard(b)
            continue
        open_bins.discard(b)
        for s in sizes[b]:
            pool.remove(s, b)
        while gap := capacity - fill[b]:
            best = (pool.longest(gap), None, None)  # gain, what leaves b, what comes
            if best[0]:
                best = (best[0], (), (best[0],))
            for y in sizes[b]:
                x = pool.longest(y + gap)
                if x - y > best[0]:
                    best = (x - y, (y,), (x,))
            if pairs and best[0] < gap:  # two for one
                for y in sizes[b]:
                    if come := pool.two(y + gap, y + best[0]):
                        best = (sum(come) - y, (y,), come)
            gain, out, come = best
            if not gain or out is None:
                break
            # the two may come from one sequence or from two; what leaves b goes to the last of them
            givers = [next(iter(pool.where[come[0]]))]
            if len(come) == 2:
                givers.append(next(a for a in pool.where[come[1]] if come[0] != come[1] or a != givers[0]))
            after = Counter({b: gain, givers[-1]: sum(out)})
            for s, a in zip(come, givers, strict=True):
                after[a] -= s
            if fill[givers[-1]] + after[givers[-1]] > capacity or sum((fill[a] + d) ** 2 - fill[a] ** 2 for a, d in after.items()) <= 0:
                break  # the squared fill wouldn't rise
            moved = [(s, take(a, s, True)) for s, a in zip(come, givers, strict=True)]
            back = [(s, take(b, s, False)) for s in out]
            for s, i in moved:
                put(b, s, i, False)
            for s, i in back:
                put(givers[-1], s, i, True)
    return [[i for items in sizes[at].values() for i in items] for at in range(len(bins)) if fill[at]]


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to the pieces; the pieces' rows are cut first, as they are read twice."""
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    shards = max(1, -(-rows.count() // shard_pieces))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_row")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        bins = improve([[i] for i in range(len(lengths))], lengths, capacity)
        seq, off = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        for k, items in enumerate(bins):
            at = 0
            for i in items:
                seq[i], off[i] = k, at
                at += lengths[i]
        pdf["sequence_id"], pdf["offset"] = seq + (int(pdf["_shard"].iloc[0]) << 32), off
        return pdf.drop(columns=["_row", "_shard"])

    sharded = rows.withColumn("_shard", F.expr(f"cast(pmod(xxhash64(_row), {shards}) as int)"))
    return sharded.groupBy("_shard").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, remember: bool = True) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    return pack_pieces(pieces(docs, vocabulary, capacity, remember), capacity, shard_pieces)
