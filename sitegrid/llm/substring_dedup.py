"""Substring dedup with a compressed FM-index per shard.

A window is `width` consecutive words of one document. A word goes if a window over it also starts, word for word, in
a document with a smaller doc_id; windows are judged on the input.

Windows are dealt to shards by content: a window's anchor is the smallest hash of the `gram`-word sequences in it, so
equal windows meet, and neighbouring windows with one anchor travel together as a region. Regions are only cut where
the anchor occurs in two documents or more (a bitmap of fixed size says so; a false alarm costs time only), and equal
regions are reduced to one, with their smallest document, before the shuffle.

A shard indexes its regions: suffixes sorted to a depth beyond the window, their Burrows-Wheeler transform in a wavelet
matrix of packed bits with block counts. The regions then stream through the index: backward search extends a match by
one word to the left; when it passes the window's width it shrinks to the interval of the first `width` words. Where
the matching statistic reaches the width, the interval's smallest document is reported for the window that starts there.

An anchor in more than `HOT_DOCS` documents (by a bitmap of fixed size) isn't a shard key: its windows travel singly, by the hash of their content,
so equal ones reduce to one and no shard grows with the anchor.

Defined cases: null, empty and short texts lose nothing; rows with a null doc_id lose nothing and take nothing from
others; rows that repeat a doc_id don't take from each other; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bitmap, cut, flags, maybe_in, stored, window_hashes

WIDTH = 50
GRAM = 8
ANCHOR_BITS = 25
DOC_BITS = 22
SHARD_WORDS = 400_000
HOT_DOCS = 10_000
HOT_BITS = 22


def window_anchors(h: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Per window start: the smallest gram hash in the window (minimum over a sliding range, by block prefixes and suffixes)."""
    n, span = len(h) - width + 1, width - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = window_hashes(h, gram)
    size = -(-len(g) // span) * span
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(g)] = g
    rows = padded.reshape(-1, span)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[span - 1 : span - 1 + n])


def regions(h: np.ndarray, width: int, gram: int):
    """(anchors, first window, one after the last window) of the runs of windows with one anchor."""
    m = window_anchors(h, width, gram)
    if not len(m):
        return m, m, m
    starts = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    return m[starts], starts, np.append(starts[1:], len(m))


def _digest(text: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(text)
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


class WaveletMatrix:
    """Rank queries on a sequence of small integers: a packed bit vector with block counts per binary digit."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        v = values
        for level in reversed(range(self.levels)):
            bit = ((v >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate([v[bit == 0], v[bit == 1]])
        self.begin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & below)
            at = np.where((symbols >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbols, at) - self.begin[symbols]


class FMIndex:
    """Index of word sequences, with the smallest document of every class of suffixes that agree in `width` words."""

    def __init__(self, sequences: list[np.ndarray], docs: np.ndarray, sigma: int, width: int):
        self.width = width
        text = np.concatenate([x for s in sequences for x in (s, [0])])  # word numbers from 1; 0 ends a sequence
        n = len(text)
        rank, have = text.astype(np.int64), 1
        tail = rank
        while have <= width:  # ranks by the first `have` words, doubled; sorted to depth > width
            nxt = np.zeros(n, np.int64)
            if have < n:
                nxt[: n - have] = rank[have:] + 1
            if 2 * have > width:
                # the first `width` words agree where the first `have` and those at width - have do
                tail = np.zeros(n, np.int64)
                if width - have < n:
                    tail[: n - (width - have)] = rank[width - have :] + 1
                half = rank
            rank = np.unique(rank * (n + sigma + 2) + nxt, return_inverse=True)[1]
            have *= 2
        order = np.argsort(rank, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        head, rest = half[order], tail[order]
        start = np.concatenate([[0], np.flatnonzero((head[1:] != head[:-1]) | (rest[1:] != rest[:-1])) + 1])
        self.class_of = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
        self.class_start, self.class_end = start, np.append(start[1:], n)
        owner = np.repeat(docs, [len(s) + 1 for s in sequences])
        self.class_least = np.minimum.reduceat(owner[order], start)
        self.size = n

    def stream(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Smallest document per window of each indexed sequence, all sequences advancing together from their ends."""
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        out = [np.empty(max(0, n - self.width + 1), np.int64) for n in lengths]
        flat = np.concatenate(sequences)
        ends = np.cumsum(lengths)
        by_length = np.argsort(-lengths, kind="stable")
        lo, hi = np.zeros(len(sequences), np.int64), np.full(len(sequences), self.size, np.int64)
        least = np.full(len(flat), -1, np.int64)
        sorted_lengths = -lengths[by_length]
        for step in range(int(lengths.max())):
            live = by_length[: np.searchsorted(sorted_lengths, -step, "left")]  # sequences longer than `step`
            at = ends[live] - 1 - step
            c = flat[at]
            both = self.first[np.concatenate([c, c])] + self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            new_lo, new_hi = both[: len(c)], both[len(c) :]
            if step + 1 >= self.width:  # matched words: min(step + 1, width + 1); shrink to the width
                k = self.class_of[new_lo]
                new_lo, new_hi = self.class_start[k], self.class_end[k]
                least[at] = self.class_least[k]
            lo[live], hi[live] = new_lo, new_hi
        for i, n in enumerate(lengths):
            out[i] = least[ends[i] - n : ends[i] - self.width + 1]
        return out


def _index_shards(batches, width: int, limit: int):
    """Rows (anchor, d1, d2, least, most, text) sorted by anchor -> smallest document per window of each region."""
    held: list[tuple] = []
    size, n_words = 0, 0

    def solve():
        ids: dict[bytes, int] = {}
        seqs = [np.fromiter((ids.setdefault(w, len(ids) + 1) for w in r[5].split()), np.int64) for r in held]
        index = FMIndex(seqs, np.array([r[3] for r in held], np.int64), len(ids) + 1, width)
        rows = [(r[0], r[1], r[2], m) for r, m in zip(held, index.stream(seqs), strict=True) if m.min() < r[4]]
        if rows:
            cols = list(zip(*rows, strict=True))
            sizes = np.fromiter(map(len, cols[3]), np.int64, len(rows))
            least = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(cols[3]), pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), least], ["anchor", "d1", "d2", "least"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if size > limit and row[0] != held[-1][0]:
                yield from solve()
                held, size = [], 0
            held.append(row)
            n_words = row[5].count(b" ") + 1
            size += n_words
    if held:
        yield from solve()


def duplicate_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot_docs: int = HOT_DOCS) -> DataFrame:
    """doc_id, text_hash and `hits`: starts (in words) of the windows that also start in an earlier document."""
    spark = docs.sparkSession
    src = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))

    def emit_anchors(batches):
        hashes = WordHashes()
        for b in batches:
            docs_, anchors = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.split()
                if len(words) >= width:
                    a = np.unique(window_anchors(hashes.of(words), width, gram))
                    anchors.append(a.view(np.int64))
                    docs_.append(np.full(len(a), doc, np.int64))
            if anchors:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), pa.array(np.concatenate(docs_))], ["anchor", "doc"])

    found = src.select("doc", "text").mapInArrow(emit_anchors, "anchor long, doc long")
    shared = cut(found.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", "n"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seen_twice = spark.sparkContext.broadcast(np.frombuffer(bitmap(shared, f"anchor & {(1 << ANCHOR_BITS) - 1}L", ANCHOR_BITS), np.uint8))
    # a false alarm among the hot ones costs time only: a region's windows then travel singly, the same way everywhere
    slot_of = lambda bits: f"anchor & {(1 << bits) - 1}L"
    hot = spark.sparkContext.broadcast(np.frombuffer(bitmap(shared.where(F.col("n") > hot_docs), slot_of(HOT_BITS), HOT_BITS), np.uint8))

    def cut_out(doc, text, hashes):
        """(anchor, start, words of the region) for regions whose anchor may be shared."""
        words = text.split()
        if len(words) < width:
            return
        anchors, first, end = regions(hashes.of(words), width, gram)
        signed = anchors.view(np.int64)
        slot = (anchors & np.uint64((1 << ANCHOR_BITS) - 1)).astype(np.int64)
        hot_slot = slot & ((1 << HOT_BITS) - 1)
        is_hot = (hot.value[hot_slot >> 3] >> (hot_slot & 7)) & 1
        for i in np.flatnonzero((seen_twice.value[slot >> 3] >> (slot & 7)) & 1):
            a = int(signed[i])
            if is_hot[i]:
                for s in range(first[i], end[i]):
                    part = b" ".join(words[s : s + width])
                    yield _digest(part)[0], int(s), part
            else:
                yield a, int(first[i]), b" ".join(words[first[i] : end[i] + width - 1])

    def emit_regions(batches):
        hashes = WordHashes()
        names = ["anchor", "d1", "d2", "doc", "text_hash", "start", "part"]

        def made(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], names)

        for b in batches:
            rows = []
            for doc, text_hash, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(a, *_digest(part), doc, text_hash, start, part) for a, start, part in cut_out(doc, text, hashes)]
                if len(rows) > 20_000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    keys = ["anchor", "d1", "d2"]
    # texts are cut up once; indexing reads the words, and the way back only the places
    cuts = stored(src.select("doc", "text_hash", "text").mapInArrow(emit_regions, "anchor long, d1 long, d2 long, doc long, text_hash long, start long, part binary"))
    parts = cuts.groupBy(*keys).agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.first("part").alias("part"))
    shards = int(max(1, total * (width + 22) // shard_words))
    dealt = parts.repartition(min(shards, 20_000), "anchor").sortWithinPartitions("anchor")
    least = dealt.mapInArrow(lambda it: _index_shards(it, width, shard_words), "anchor long, d1 long, d2 long, least array<long>")
    places = cuts.select(*keys, "doc", "text_hash", "start")
    starts = F.filter(F.transform("least", lambda m, i: F.when(m < F.col("doc"), F.col("start").cast("int") + i)), lambda x: x.isNotNull())
    hits = places.join(least, keys).select("doc", "text_hash", starts.alias("s")).where(F.size("s") > 0)
    return hits.groupBy("doc", "text_hash").agg(F.flatten(F.collect_list("s")).alias("hits"))


def covered(n: int, starts, width: int) -> np.ndarray:
    """Mask of the words that lie in a window with one of these starts."""
    edge = np.zeros(n + 1, np.int64)
    starts = np.unique(starts)
    edge[starts] += 1
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:-1] > 0


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by one space)."""
    hits = cut(duplicate_windows(docs, width))
    may = F.coalesce(maybe_in(flags(hits, "doc", DOC_BITS, stored), "doc_id", DOC_BITS), F.lit(False))
    src = docs.select("doc_id", "text")
    on = (F.col("doc_id") == F.col("doc")) & (F.col("h") == F.col("text_hash"))
    some = src.where(may).withColumn("h", F.xxhash64("text")).join(hits, on, "left").select("doc_id", F.col("text").cast("binary"), "hits")
    rows = some.unionByName(src.where(~may).select("doc_id", F.col("text").cast("binary"), F.lit(None).cast("array<int>").alias("hits")))

    def run(batches):
        for b in batches:
            n, gone, sha, kept = [], [], [], []
            for text, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.split() if text else []
                n.append(len(words))
                if starts:
                    stay = ~covered(len(words), np.array(starts, np.int64), width)
                    words = [words[i] for i in np.flatnonzero(stay)]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
