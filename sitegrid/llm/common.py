"""Helpers shared by the operators: table access, word splitting, hashing, Arrow mapping, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import Kept, cut, released, shared_folder, stored

__all__ = ["Kept", "cut", "released", "shared_folder", "stored"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Operator -> how to forget what it remembers from task to task in a Python worker.
REMEMBERED: dict[str, Callable[[], None]] = {}


def tidy(owner: str = "") -> None:
    """The worker may have served other operators: forget their memories, hand freed pages back."""
    for name, forget in REMEMBERED.items():
        if name != owner:
            forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """A map over batches that tidies at a task's start and, its own memory gone, at its end: an idle worker holds little."""

    def tidy_run(batches):
        tidy(owner)
        yield from run(batches)
        tidy(owner)

    return tidy_run


class WordHashes(dict):
    """word bytes -> 64-bit hash; remembers at most `limit` words."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps around on purpose)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all windows of k words, by doubling; empty if there are fewer words."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, have, out, done = word_hashes, 1, None, 0
    while True:
        if k & have:
            part = power[done : done + n]
            out = part.copy() if out is None else mix(out * MIX + part)
            done += have
        if done == k:
            return out
        power = mix(power[:-have] * MIX + power[have:])
        have *= 2


def shingle_set(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of ASCII-lower-cased text; a shorter text is one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(window_hashes(h, min(k, len(h))) if len(h) >= k else mix(window_hashes(h, len(h)) + np.uint64(len(h))))


def slices(n: int, sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about `most`; a larger row stands alone."""
    out, start, total = [], 0, 0
    for i in range(n):
        if i > start and total + sizes[i] > most:
            out.append((start, i))
            start, total = i, 0
        total += int(sizes[i])
    return [*out, (start, n)] if n > start else out


def _slots(df: DataFrame, slot: Column) -> DataFrame:
    """(w, v): a 64-bit word's number and the flag in it, for the slot of every row."""
    return df.select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("w"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("v"))


def _slot(key: str, bits: int) -> Column:
    return F.expr(f"pmod(xxhash64({key}), {1 << bits}L)")


def bitmap(df: DataFrame, slot: str, bits: int) -> bytes:
    """A bitmap of 2**bits flags, `slot` being SQL for a flag's number, for Python workers; its size is fixed by `bits`.

    Words of 64 flags are merged by bit_or, so the driver gets 2**bits / 8 bytes whatever the rows.
    """
    out = np.zeros(1 << (bits - 6), np.int64)
    with released(df.sparkSession):
        got = _slots(df, F.expr(slot)).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out.tobytes()


def dense(words: DataFrame, size: int, keep: Callable[[DataFrame], DataFrame]) -> Column:
    """An array of `size` longs (a power of two over 1024) from rows (w, v): equal w are or-ed, absent ones are 0.

    It is a scalar subquery over a stored table of one row, so neither plans nor the driver's Python hold its numbers.
    """
    zeros = words.sparkSession.range(0, size, 1, 1).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    full = zeros.unionByName(words).groupBy("w").agg(F.bit_or("v").alias("v"))
    parts = full.groupBy(F.shiftright("w", 10).alias("b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "v"))), lambda x: x.v).alias("a"))
    return keep(parts.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("b", "a"))), lambda x: x.a)).alias("a"))).scalar()


def flags(df: DataFrame, key: str, bits: int, keep: Callable[[DataFrame], DataFrame]) -> Column:
    """2**bits flags over hashes of the columns `key`, for maybe_in(); the size is fixed by `bits`."""
    return dense(_slots(df, _slot(key, bits)), 1 << (bits - 6), keep)


def maybe_in(flags: Column, key: str, bits: int) -> Column:
    """Predicate for flags(): false only for keys that were not put in."""
    slot = _slot(key, bits)
    word = F.get(flags, F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) != 0


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], rounds: int = 60) -> DataFrame:
    """(node, root): smallest node reachable over the edges (a, b), for every node that has an edge.

    Large-star and small-star alternate until nothing changes; every step is written to the shared folder, which also
    counts its rows, and no step gathers a component in one task: neighbours are only reduced to their minimum, and
    the joins that hand it back are split where a node is hot.
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = keep(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        return out, (seen.get["n"], seen.get["h"])

    e, state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if not state[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        e, new = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if new == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = new
    raise RuntimeError("components did not settle")
