"""URL filters: allow and block rules kept as a sorted array of 64-bit digests.

`DigestIndex` holds the xxhash64 of every rule key (`host/path`) in ascending order, plus the full keys in the same
order. Lists are tables of any size: Spark reduces equal keys, sorts by digest and cuts the order into ranges of about
`RANGE_KEYS` keys; each range becomes arrays in the cluster's shared folder that reach the executors through
SparkContext.addFile. The driver passes on one range at a time. Workers memory-map the arrays, so the size of a list
isn't bounded by a worker's memory. A batch of urls is probed with one vectorised binary search per range for all host
suffixes and path lengths that occur in the list, and every hit is confirmed by the stored full key, so a collision of
digests can't change a verdict.

A rule fits its host and all subdomains when the url's path starts with the rule's path; of several the longest
key wins, and block wins between equally long ones. Without a fitting rule the method's own verdict is: block if a
label of the host is in the table of spam labels (a second digest index), else allow.

Defined cases: a null url or one without `://` has empty host and path and no rule, and is allowed; repeated rows are
judged separately; other columns are ignored; an empty table gives no rows. An empty rule list is allowed; null keys in
a list are left out, and a key that is listed twice blocks if one of its rows does.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_folder

#: Keys in one range of an index; the driver passes on one range at a time.
RANGE_KEYS = 1_000_000
#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Host labels of known spam; the method's own list.
SPAM_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) by plain delimiters: no default path, no decoding, only A-Z lower-cased."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = _HOST_END.search(rest)
    host, rest = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    end = _PATH_END.search(rest)
    return host.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"), rest[: end.start()] if end else rest


def digest(key: str) -> int:
    """Spark's xxhash64 of a string, as a signed number."""
    h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


class DigestIndex:
    """Sorted digests with their keys, in one range or several; `values` are small integers."""

    PARTS = {"digests": np.dtype("<i8"), "starts": np.dtype("<i8"), "keys": np.dtype("u1"), "values": np.dtype("u1")}

    def __init__(self, ranges: list[dict[str, np.ndarray]]):
        self.ranges = ranges
        self.first = np.array([r["digests"][0] for r in ranges], np.int64)

    @staticmethod
    def arrays(rows: Iterable[tuple[int, str, int]]) -> dict[str, np.ndarray]:
        """The arrays of rows (digest, key, value) that are sorted by digest."""
        digests, raw, values = zip(*((h, k.encode("utf-8", "surrogatepass"), v) for h, k, v in rows), strict=True)
        starts = np.concatenate([[0], np.cumsum([len(k) for k in raw])])
        return {"digests": np.array(digests, "<i8"), "starts": starts.astype("<i8"), "keys": np.frombuffer(b"".join(raw), np.uint8), "values": np.array(values, np.uint8)}

    @staticmethod
    def ship(entries: DataFrame, range_keys: int = RANGE_KEYS) -> list[str]:
        """Build the index of a table (key, value) and hand its files to all executors; returns the names of its ranges."""
        spark = entries.sparkSession
        rows = entries.where("key is not null").groupBy("key").agg(F.max("value").alias("value")).select(F.xxhash64("key").alias("d"), "key", F.col("value").cast("int").alias("value"))
        n = max(1, -(-rows.count() // range_keys))
        ordered = rows.repartitionByRange(n, "d") if n > 1 else rows.coalesce(1)

        def pack(batches):
            got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if got:
                made = DigestIndex.arrays(got)
                yield pa.RecordBatch.from_arrays([pa.array([made[p].tobytes()], pa.binary()) for p in DigestIndex.PARTS], list(DigestIndex.PARTS))

        packed = ordered.sortWithinPartitions("d", "key").mapInArrow(pack, ", ".join(f"{p} binary" for p in DigestIndex.PARTS))
        jvm, root, names = spark._jvm, f"{new_folder(spark, 'digest-index')}", []
        for k, row in enumerate(packed.toLocalIterator()):
            names.append(f"{root.rsplit('/', 1)[1]}-{k}")
            for part in DigestIndex.PARTS:
                path = jvm.org.apache.hadoop.fs.Path(f"{root}/{names[-1]}.{part}")
                out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
                for i in range(0, len(row[part]), 1 << 24):
                    out.write(bytes(row[part][i : i + (1 << 24)]))
                out.close()
                spark.sparkContext.addFile(path.toString())
        return names

    @staticmethod
    def opened(names: list[str]) -> DigestIndex:
        """The index in a worker, memory-mapped from the files that Spark has fetched."""

        def part(name, p, kind):
            path = SparkFiles.get(f"{name}.{p}")
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)

        return DigestIndex([{p: part(n, p, kind) for p, kind in DigestIndex.PARTS.items()} for n in names])

    def find(self, keys: list[str], hashed=digest) -> list[int]:
        """Value of every key, -1 where absent: one binary search a range for all its keys, confirmed by the full key."""
        out = [-1] * len(keys)
        if not self.ranges or not keys:
            return out
        h = np.fromiter((hashed(k) for k in keys), np.int64, len(keys))
        of = np.maximum(np.searchsorted(self.first, h, "right") - 1, 0)
        for k in np.unique(of):
            r, own = self.ranges[k], np.flatnonzero(of == k)
            digests, starts = r["digests"], r["starts"]
            at = np.searchsorted(digests, h[own])
            for i, j in zip(own.tolist(), at.tolist(), strict=True):
                if j == len(digests) or digests[j] != h[i]:
                    continue
                raw = keys[i].encode("utf-8", "surrogatepass")
                while j < len(digests) and digests[j] == h[i]:
                    if r["keys"][starts[j] : starts[j + 1]].tobytes() == raw:
                        out[i] = int(r["values"][j])
                        break
                    j += 1
        return out


def host_suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    out, at = [host] if host else [], host.find(".")
    while at >= 0:
        if host[at + 1 :]:
            out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def match_rules(hosts: list[str], paths: list[str], index: DigestIndex, path_sizes: list[int]) -> list[tuple[str, int] | None]:
    """(key, value) of the longest fitting rule of each url, None if none fits."""
    keys, owner = [], []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        for suffix in host_suffixes(host):
            for n in path_sizes:
                if len(path) >= n:
                    keys.append(suffix + path[:n])
                    owner.append(i)
    best: list[tuple[str, int] | None] = [None] * len(hosts)
    for key, i, value in zip(keys, owner, index.find(keys), strict=True):
        if value >= 0 and (best[i] is None or (len(key), value) > (len(best[i][0]), best[i][1])):
            best[i] = (key, value)
    return best


def judge(pages: DataFrame, rules: DataFrame | None = None, spam_labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every url; no shuffle, html isn't read.

    rules: a table (host, path, verdict), by default the few of RULES; spam_labels: a table (label), by default SPAM_LABELS.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    if spam_labels is None:
        spam_labels = spark.createDataFrame([(x,) for x in SPAM_LABELS], "label string")
    rule_names = DigestIndex.ship(rules.select(F.concat("host", "path").alias("key"), F.when(F.col("verdict") == "block", 2).otherwise(1).alias("value")))
    spam_names = DigestIndex.ship(spam_labels.select(F.col("label").alias("key"), F.lit(2).alias("value")))
    path_sizes = sorted(r[0] for r in rules.select(F.length("path").alias("n")).where("n is not null").distinct().collect())

    def run(batches):
        index, spam = DigestIndex.opened(rule_names), DigestIndex.opened(spam_names)
        for b in batches:
            pairs = [split_url(u) for u in b.column(1).to_pylist()]
            hosts, paths = [p[0] for p in pairs], [p[1] for p in pairs]
            found = match_rules(hosts, paths, index, path_sizes)
            labels, owner = [], []
            for i, host in enumerate(hosts):
                if found[i] is None:
                    for x in host.split("."):
                        labels.append(x)
                        owner.append(i)
            spammy = {i for i, v in zip(owner, spam.find(labels), strict=True) if v >= 0}
            rule = [f[0] if f else None for f in found]
            verdict = [("block" if f[1] == 2 else "allow") if f else "block" if i in spammy else "allow" for i, f in enumerate(found)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict))], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
