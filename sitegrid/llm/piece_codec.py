"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct segments (a run of blanks and the text up to the next one; no piece reaches past that) are
concatenated and indexed by a suffix array, sorted to the length of the longest piece. Every piece is looked up by
binary search; its occurrences are edges from one text position to a later one. The edges are sorted by the position
where they end and relaxed in that order, for all segments side by side: an edge extends the encoding of the prefix
where it starts if the two pieces may stand side by side. For a BPE model that is so exactly if no merge across their
border would come before the merges inside them, and exactly one edge survives at each position, so the path that
remains at a segment's end is the model's encoding. Characters without a piece become their bytes.

Decoding joins the pieces, bytes decoded as UTF-8, and takes the leading blank away that encoding adds.

Merges of pure blank runs all have one score and are settled left to right, so a run's edge set is replaced by that
rule. Segments already met are remembered, up to a bound.

Defined cases: a null text gives no ids, like an empty one; a null doc_id stays null; repeated rows are encoded one by
one; a text of any length is encoded whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, tidy

BLANK = "▁"
VOCABULARY = "piece_bpe_32k.model"
TEXT_CHARS = 1_000_000
SEPARATOR = 0x110000  # beyond all characters
_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Pieces:
    """A BPE model's pieces, ordered by when their merge applies, and which two may stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = {}
        normal = []
        for i, t in enumerate(self.text):
            if model.is_byte(i):
                self.byte_id[int(t[3:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append(i)
        if any(BLANK in self.text[i].lstrip(BLANK) for i in normal):
            raise ValueError("a piece goes on after a blank; segments can't be encoded one by one")
        # rank 0.. for single characters, then merges from the first to the last
        normal.sort(key=lambda i: (len(self.text[i]) > 1, -model.get_score(i) if len(self.text[i]) > 1 else 0, i))
        self.ids = np.array(normal, np.int64)
        self.rank = {self.text[i]: r for r, i in enumerate(normal)}
        self.names = [self.text[i] for i in normal]
        self.unknown = len(normal)  # ranks from here on stand for characters without a piece
        self.left, self.right = list(range(len(normal))), list(range(len(normal)))
        self.reachable = np.ones(len(normal), bool)
        for r, t in enumerate(self.names):
            if len(t) > 1:
                parts = self._last_merge(t)
                if parts is None:
                    self.reachable[r] = False
                else:
                    self.left[r], self.right[r] = parts
        self.blank_runs = sorted((len(t) for t in self.rank if set(t) == {BLANK}), reverse=True)
        self.known_pairs: dict[int, bool] = {}
        self.longest = max(map(len, self.names))

    def _last_merge(self, t: str) -> tuple[int, int] | None:
        """The two pieces that the merges of t's characters join last; None if they don't end in t."""
        parts = list(t)
        if set(t) == {BLANK}:
            return (self.rank[t[:-1]], self.rank[t[-1]]) if t[:-1] in self.rank else None
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 60:
                return None
            k = best[1]
            if len(parts) == 2:
                return (self.rank[parts[0]], self.rank[parts[1]]) if parts[0] in self.rank and parts[1] in self.rank else None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether pieces a, b stay apart: undo their merges, latest first, and look for one across the border before it."""
        if a >= self.unknown or b >= self.unknown:
            return True
        limit = 1 << 60
        while True:
            merged = self.rank.get(self.names[a] + self.names[b])
            if merged is not None and merged < limit:
                return False
            # of equal merges the left one comes first
            if a > b:
                limit, a2 = a, self.right[a]
                if a2 != a:
                    a = a2
                    continue
                return True
            limit, b2 = b + 1, self.left[b]
            if b2 != b:
                b = b2
                continue
            if self.right[a] == a:
                return True
            limit, a = a, self.right[a]

    def pairs_ok(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, back = np.unique(a * (1 << 32) + b, return_inverse=True)
        known, out = self.known_pairs, np.empty(len(keys), bool)
        if len(known) > 1_000_000:
            known.clear()
        for i, k in enumerate(keys.tolist()):
            v = known.get(k)
            if v is None:
                v = known[k] = self.may_follow(k >> 32, k & 0xFFFFFFFF)
            out[i] = v
        return out[back]


class Matcher:
    """Encodes distinct segments: suffix array, piece occurrences, relaxation."""

    def __init__(self, pieces: Pieces):
        self.p = pieces

    def _occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, piece rank) of every occurrence of every piece in the text, and the positions no single piece covers."""
        p, width = self.p, self.p.longest
        alphabet, dense = np.unique(codes, return_inverse=True)
        kind = ">u1" if len(alphabet) < 250 else ">u2" if len(alphabet) < 65000 else ">u4"
        padded = np.zeros(len(dense) + width, kind)
        padded[: len(dense)] = dense + 1
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[: len(dense)]).view(f"S{width * padded.itemsize}").ravel()
        order = np.argsort(suffixes, kind="stable")
        suffixes = suffixes[order]
        number = {chr(c): i + 1 for i, c in enumerate(alphabet.tolist()) if c != SEPARATOR}
        ranks = [r for r in range(len(p.names)) if p.reachable[r] and all(c in number for c in p.names[r])]
        low = np.zeros((len(ranks), width), kind)
        high = np.full((len(ranks), width), np.iinfo(kind).max, kind)
        for k, r in enumerate(ranks):
            row = [number[c] for c in p.names[r]]
            low[k, : len(row)] = high[k, : len(row)] = row
        as_key = lambda m: np.ascontiguousarray(m).view(suffixes.dtype).ravel()
        a = np.searchsorted(suffixes, as_key(low), "left")
        b = np.searchsorted(suffixes, as_key(high), "right")
        count = b - a
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - ends + count, count)
        start, rank = order[at], np.repeat(np.array(ranks, np.int64), count)
        single = np.zeros(len(dense), bool)
        single[start[rank < self._singles()]] = True
        return start, rank, np.flatnonzero(~single)

    def _singles(self) -> int:
        return sum(1 for n in self.p.names if len(n) == 1)

    def encode(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of each segment; segments don't start with more than one blank."""
        p = self.p
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = np.frombuffer((" ".join(segments) + " ").encode("utf-32-le"), "<u4").astype(np.int64)
        inside = np.ones(len(text), bool)
        inside[begin + sizes] = False
        text[~inside] = SEPARATOR
        start, rank, bare = self._occurrences(text)
        bare = bare[inside[bare]]
        start = np.concatenate([start, bare])
        rank = np.concatenate([rank, p.unknown + text[bare]])
        width = np.array([len(n) for n in p.names] + [1], np.int64)
        end = start + width[np.minimum(rank, p.unknown)]
        # a separator is no piece, so no edge crosses one; positions count from a segment's start
        owner = np.repeat(np.arange(len(segments)), sizes + 1)
        ok = inside[start]
        start, rank, end = start[ok], rank[ok], end[ok]
        depth = end - begin[owner[start]]
        # numbers of 16 bits are sorted digit by digit
        order = np.argsort(depth.astype(np.uint16) if sizes.max(initial=0) < 1 << 16 else depth, kind="stable")
        start, rank, end, depth = start[order], rank[order], end[order], depth[order]
        last = np.full(len(text) + 1, -1, np.int64)
        back = np.zeros(len(text) + 1, np.int64)
        first = np.zeros(len(text) + 1, bool)
        first[begin] = True
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, r, e = start[i:j], rank[i:j], end[i:j]
            good = first[s]
            rest = np.flatnonzero(~good & (last[s] >= 0))
            if len(rest):
                good[rest] = p.pairs_ok(last[s[rest]], r[rest])
            last[e[good]], back[e[good]] = r[good], s[good]
        # walk all segments back from their ends
        at, seg = begin + sizes, np.arange(len(segments))
        got_seg, got_rank = [], []
        while len(seg):
            got_seg.append(seg)
            got_rank.append(last[at])
            at = back[at]
            more = at > begin[seg]
            at, seg = at[more], seg[more]
        if not got_seg:
            return []
        seg, rank = np.concatenate(got_seg[::-1]), np.concatenate(got_rank[::-1])
        order = np.argsort(seg, kind="stable")
        seg, rank = seg[order], rank[order]
        if (rank < 0).any():
            raise AssertionError("a segment was left without an encoding")
        ids = np.where(rank < p.unknown, p.ids[np.minimum(rank, p.unknown - 1)], -1)
        cuts = np.searchsorted(seg, np.arange(len(segments) + 1))
        out = []
        odd = set(seg[ids < 0].tolist())
        for k in range(len(segments)):
            part = ids[cuts[k] : cuts[k + 1]]
            if k in odd:
                part = np.array([x for i, r in zip(part.tolist(), rank[cuts[k] : cuts[k + 1]].tolist(), strict=True) for x in ([i] if i >= 0 else [p.byte_id[b] for b in chr(r - p.unknown).encode("utf-8", "replace")])], np.int64)
            out.append(part)
        return out


class Codec:
    """Texts to ids and back; remembers the ids of a bounded number of segments."""

    def __init__(self, path: str, limit: int = 350_000):
        self.pieces, self.limit = Pieces(path), limit
        self.matcher = Matcher(self.pieces)
        self.memory: dict[str, bytes] = {}
        self.raw = [bytes([int(t[3:-1], 16)]) if i in set(self.pieces.byte_id.values()) else t.encode() for i, t in enumerate(self.pieces.text)]
        self.raw[:3] = [b"", b"", b""] if self.pieces.text[1:3] == ["<s>", "</s>"] else self.raw[:3]

    @staticmethod
    def segments(text: str) -> list[str]:
        """Blank runs with the text up to the next one, the model's leading blank included."""
        return _SEGMENT.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def _blanks(self, n: int) -> list[int]:
        """Ids of n blanks: their merges have one score, so the leftmost pair that makes a piece goes first."""
        p, runs = self.pieces, []
        for _ in range(n):
            runs.append(1)
            while len(runs) > 1 and BLANK * (runs[-2] + runs[-1]) in p.rank:
                runs[-2:] = [runs[-2] + runs[-1]]
        return [int(p.ids[p.rank[BLANK * k]]) for k in runs]

    def learn(self, segments: set[str]) -> None:
        """Adds the segments to the memory."""
        plain, chars, wide = {}, 0, []
        for s in segments:
            body = s.lstrip(BLANK)
            if not body:
                self.memory[s] = np.array(self._blanks(len(s)), "<u4").tobytes()
                continue
            if len(s) - len(body) > 1:
                wide.append(s)
                s = BLANK + body
                if s in self.memory:
                    continue
            if s not in plain:
                plain[s] = None
                chars += len(s) + 1
            if chars > TEXT_CHARS:
                self._keep(list(plain))
                plain, chars = {}, 0
        self._keep(list(plain))
        one = np.array([self.pieces.ids[self.pieces.rank[BLANK]]], "<u4").tobytes()
        for s in wide:
            body = s.lstrip(BLANK)
            tail, blanks = self.memory[BLANK + body], len(s) - len(body)
            # the last blank belongs to the run unless it merged with the text
            if tail[:4] == one:
                tail = tail[4:]
            else:
                blanks -= 1
            self.memory[s] = np.array(self._blanks(blanks), "<u4").tobytes() + tail

    def _keep(self, plain: list[str]) -> None:
        if plain:
            self.memory.update(zip(plain, (i.astype("<u4").tobytes() for i in self.matcher.encode(plain)), strict=True))

    def encode(self, texts: list[str | None]):
        """Ids of each text as little-endian uint32."""
        at = 0
        while at < len(texts):
            split, fresh, n = [], set(), 0
            while at < len(texts) and n < 2_000_000:
                split.append(self.segments(texts[at]) if texts[at] else [])
                fresh.update(s for s in split[-1] if s not in self.memory)
                n += len(split[-1])
                at += 1
            if len(self.memory) + len(fresh) > self.limit:
                # what this round needs again isn't learnt again
                needed = set().union(*split)
                self.memory = {s: ids for s, ids in self.memory.items() if s in needed}
            self.learn(fresh)
            for parts in split:
                yield b"".join(map(self.memory.__getitem__, parts))

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=1)
def _codec(path: str) -> Codec:
    """One codec a Python worker: its memory outlives a task."""
    return Codec(path)


REMEMBERED["piece_codec"] = _codec.cache_clear


def encode_documents(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, decoded_sha256 and round_trip (decoding gives the text back) of every document."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"] + ["ids"] * with_ids

    def run(batches):
        tidy("piece_codec")
        codec = _codec(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            n, crc, sha, same, every = [], [], [], [], []
            for text, ids in zip(texts, codec.encode(texts), strict=True):
                back = codec.decode(ids)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                sha.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(back == (text or ""))
                every.append(np.frombuffer(ids, "<u4").astype(np.int32) if with_ids else None)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(every, pa.list_(pa.int32()))] * with_ids, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
