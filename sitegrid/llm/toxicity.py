"""Toxicity by multiple-instance learning: sentences are scored, a noisy-or makes the document's score.

A document is a bag of sentences; p(document) = 1 - prod(1 - p(sentence)). Only document labels are known; the
gradient of the bag's likelihood reaches the sentences through the noisy-or. A sentence's logit is a bias plus the
weights of its words' features: the word itself and its beginnings of 4 and 5 letters, which carry over to unseen
endings. Features are screened on the bags first: only those that occur in at least `LEAST_BAGS` toxic bags, there at
least `LEAST_RATIO` times as often as in the others, and too often for chance (a log-likelihood ratio of
`LEAST_EVIDENCE`), can get a weight, so nothing is learnt by heart from one bag.
The fitted sentence model then also locates the offending sentences.

The fit uses a bounded sample of labelled rows (`SAMPLE`), those of smallest hash, gathered in one task, never rows
whose crc32(doc_id as text) mod 4 is 2; everything else is one map over all whole texts.

Defined cases: a null or empty text has no sentence and scores 0; a null doc_id is never in the sample and comes back
null with held_out null; repeated rows are scored one by one; without labels of both kinds all scores are 0; other
columns are ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, tidied

SAMPLE = 4000
LEAST_BAGS = 3
LEAST_RATIO = 8.0
LEAST_EVIDENCE = 16.0
LONGEST = 60  # words of a sentence without an end mark
THRESHOLD = 0.3
_EDGE = b".,;:!?\"'()[]{}|*#$%&<>-_"


def word_features(word: bytes) -> list[str]:
    """Features of a lower-cased word without its punctuation."""
    text = word.strip(_EDGE).decode("utf-8", "replace")
    return [f"w:{text}", *(f"{k}:{text[:k]}" for k in (4, 5) if len(text) >= k)] if text else []


def sentence_starts(ends: np.ndarray) -> np.ndarray:
    """Word number of every sentence's first word: after an end mark, and after LONGEST words without one."""
    n = len(ends)
    cuts = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
    gaps = np.diff(np.append(cuts, n))
    if (gaps <= LONGEST).all():
        return cuts
    return np.concatenate([np.arange(c, c + g, LONGEST) for c, g in zip(cuts, gaps, strict=True)])


class Model:
    """Weights by feature, and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self, limit: int = 200_000):
        weights, ends = self.weights, (b".", b"!", b"?")

        class Words(dict):
            def __missing__(self, word):
                v = sum(weights.get(f, 0.0) for f in word_features(word))
                # the end mark rides on the imaginary part: one lookup a word
                v = complex(v, word.endswith(ends))
                if len(self) >= limit:
                    self.clear()
                self[word] = v
                return v

        words = Words()

        def score(text: bytes | None):
            """Document score, logits of its sentences and their first words."""
            parts = text.lower().split() if text else []
            if not parts:
                return 0.0, np.empty(0), np.empty(0, np.int64)
            v = np.fromiter(map(words.__getitem__, parts), np.complex128, len(parts))
            starts = sentence_starts(v.imag > 0)
            z = np.add.reduceat(v.real, starts) + self.bias
            return float(-np.expm1(-np.logaddexp(0, z).sum())), z, starts

        return score


def fit(texts: list[bytes], labels: list[int], steps: int = 300, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Adam on the bags' likelihood, over the screened features."""
    y = np.array(labels, np.float64)
    zero = Model({}, -30.0)
    if not len(y) or y.min() == y.max():
        return zero
    ids: dict[bytes, int] = {}
    tokens, starts_of, first_sent = [], [], [0]  # word ids and sentences' first words of a bag, and its first sentence's number
    doc_of = []
    for d, text in enumerate(texts):
        parts = text.lower().split() if text else []
        if not parts:
            continue
        starts = sentence_starts(np.array([w[-1:] in (b".", b"!", b"?") for w in parts]))
        tokens.append(np.fromiter((ids.setdefault(w, len(ids)) for w in parts), np.int32, len(parts)))
        starts_of.append(starts.astype(np.int32))
        doc_of.append(np.full(len(starts), d))
        first_sent.append(first_sent[-1] + len(starts))
    if not tokens:
        return zero
    doc_of, n_sent = np.concatenate(doc_of), first_sent[-1]
    # features are numbered by hash, so that no table of their names is kept
    size = np.zeros(len(ids), np.int64)
    hashed = array("Q")
    for i, w in enumerate(ids):
        own = word_features(w)
        size[i] = len(own)
        hashed.extend(xxhash.xxh3_64_intdigest(f) for f in own)
    hashes, flat = np.unique(np.frombuffer(hashed, np.uint64), return_inverse=True)
    first, n_feats = np.concatenate([[0], np.cumsum(size)]), len(hashes)

    def spread(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in `words`, feature) for every feature of every word."""
        n = size[words]
        ends = np.cumsum(n)
        return np.repeat(np.arange(len(words)), n), flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[words] - ends + n, n)]

    # bag by bag, so that no table of all words' features is held at once
    pos, neg = np.zeros(n_feats, np.int64), np.zeros(n_feats, np.int64)
    for words, start in zip(tokens, first_sent, strict=False):
        bag = pos if y[doc_of[start]] > 0 else neg
        bag[np.unique(spread(np.unique(words))[1])] += 1
    n_pos, n_neg = y.sum(), len(y) - y.sum()
    good = (pos >= LEAST_BAGS) & ((pos + 0.5) / (n_pos + 1) >= LEAST_RATIO * (neg + 0.5) / (n_neg + 1))
    both, rate_all = pos + neg, n_pos / len(y)
    entropy = lambda k, n, q: np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(n * q, 1e-12)), 0.0)
    good &= 2 * (entropy(pos, both, rate_all) + entropy(neg, both, 1 - rate_all)) >= LEAST_EVIDENCE
    number = np.cumsum(good) - 1
    # a table of how often a screened feature occurs in a sentence
    keys, counts = [], []
    for words, starts, start in zip(tokens, starts_of, first_sent, strict=False):
        at, f = spread(words)
        ok = good[f]
        key, count = np.unique((start - 1 + np.searchsorted(starts, at[ok], "right") << 32) | number[f[ok]], return_counts=True)
        keys.append(key)
        counts.append(count)
    key, count = np.concatenate(keys), np.concatenate(counts)
    s_of, f_of = key >> 32, key & 0xFFFFFFFF
    k = int(good.sum())
    if not k:
        return zero
    w, m, v = np.zeros(k), np.zeros(k), np.zeros(k)
    bias, mb, vb = -6.0, 0.0, 0.0
    share = 1 / len(y)
    for step in range(1, steps + 1):
        z = np.bincount(s_of, weights=w[f_of] * count, minlength=n_sent) + bias
        total = np.bincount(doc_of, weights=np.logaddexp(0, z), minlength=len(y))
        slope = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) * share
        g = slope[doc_of] / (1 + np.exp(-np.clip(z, -50, 50)))
        gw, gb = np.bincount(f_of, weights=g[s_of] * count, minlength=k) + decay * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-7)
        bias -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-7)
    by_hash = dict(zip(hashes[good].tolist(), w.tolist(), strict=True))
    named = {f: by_hash[h] for t in ids for f in word_features(t) if (h := xxhash.xxh3_64_intdigest(f)) in by_hash}
    return Model(named, float(bias))


def held_out():
    """Rows never learnt from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows: the ids of smallest hash, picked from the labels alone."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # rows that repeat a doc_id count once, so the sample is bounded whatever the table repeats
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def run(batches):
        got = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: (r[0], r[1] or b""))
        if got:
            model = fit([r[1] for r in got], [int(r[2]) for r in got])
            names = [*model.weights, ""]  # the bias has no name
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*model.weights.values(), model.bias], pa.float64())], ["feature", "weight"])

    # the bounded sample meets in one task, so that the driver holds nothing but the weights
    fitted = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).repartition(1).mapInArrow(tidied(run), "feature string, weight double")
    with released(docs.sparkSession):
        found = dict(map(tuple, fitted.collect()))
    bias = found.pop("", -30.0)
    return Model(found, bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: list[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences (first word:one after the last word, from 0)."""

    def run(batches):
        scorer = model.scorer()
        for b in batches:
            scores, found = [], []
            for text in b.column("text").to_pylist():
                p, z, starts = scorer(text)
                scores.append(p)
                bad = np.flatnonzero(z >= -0.85) if p >= threshold else ()
                ends = np.append(starts[1:], len(text.split())) if len(bad) else ()
                found.append(",".join(f"{starts[i]}:{ends[i]}" for i in bad))
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found, pa.string())],
                [*names, "score", "predicted", "sentences"],
            )

    src = docs.select("doc_id", *keep, F.col("text").cast("binary").alias("text"), held_out().alias("held_out"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text")
    return src.mapInArrow(tidied(run), f"{schema}, score double, predicted int, sentences string")


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't rejected, with all their columns; scored and filtered in one map, without a join."""
    model = train(docs, labels)

    def run(batches):
        scorer = model.scorer()
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            ok = [scorer(t.encode() if t else None)[0] < threshold for t in texts.to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
