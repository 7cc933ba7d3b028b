"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set are the distinct hashes of its k-word shingles (ASCII-lower-cased; a shorter text is one shingle).
Two documents link when the Jaccard similarity of their sets is at least `percent` / 100; components follow from links.

1. A sketch of fixed size counts, over all documents, how many shingles fall into each hash bucket. Shingles are
   ordered rare first by it, so common passages stay out of prefixes.
2. Every document emits a prefix of n - ceil(percent * n / 100) + l shingles. l is chosen per document: where the
   sketch foretells many candidates, a longer prefix is taken, and l shared prefix shingles are asked for instead of
   one. In general two documents with prefixes p_x, p_y must share overlap - max(n_x - p_x, n_y - p_y) of them.
3. Equal sets are one class from then on. Prefix rows are dealt by shingle and sorted; a shingle with up to `MOST`
   documents gives the pairs that pass the length and positional filters, one with more only a star of edges.
4. Pairs that share enough prefix shingles, and stars, make candidate clusters. Each document travels once to its
   cluster's task, where all links inside are verified on whole sets.
5. The fuller the sketch, the more frequent shingles it hides, and their stars string strangers together. So steps 1
   to 4 are done again, `AGAIN` times at most, for the documents of clusters over `CLUSTER_SHINGLES` alone, with a sketch
   of their own. What is still over the bound is cut into blocks and verified block against block, so a task's memory
   is bounded, and no pair is left out.

No step emits all pairs of a group, and the result is one row per document with its component.

Defined cases: null or empty texts, or without words, have an empty set, link with nothing and are their own
component; rows with a null doc_id get their set's size and a null component; rows repeating a doc_id are told apart
by their sets; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, WordHashes, components, flags, maybe_in, released, shingle_set, stored, tidied

K = 5
PERCENT = 80
SKETCH_BITS = 22
#: Steps of a sketch's level for a doubled count: levels are 16 bits for any count of 32.
LEVEL_STEPS = 2048
BLOCK_BITS = 12
MOST = 24
LONGEST_EXTRA = 8
VERIFY_WEIGHT = 8.0
CLUSTER_SHINGLES = 3_000_000
AGAIN = 2
BITMAP_BITS = 22


def level(counts: np.ndarray) -> np.ndarray:
    """Counts as 16-bit logarithms, which sort like them."""
    return np.minimum(np.round(LEVEL_STEPS * np.log2(counts + 1.0)), 65535).astype("<u2")


def counted(levels: np.ndarray) -> np.ndarray:
    """The counts of levels, to a few parts in ten thousand."""
    return np.exp2(levels / LEVEL_STEPS) - 1


def sketch(docs: DataFrame, k: int = K, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many distinct shingles of a document fall into each of 2**bits buckets, summed over all documents, as levels.

    A task emits its counts in blocks, the bytes of equal weight side by side and compressed; blocks are dealt by number
    and added up as they stream by.
    """
    block_bits = min(BLOCK_BITS, bits)
    width = 1 << block_bits

    def count(batches):
        hashes, total = WordHashes(), np.zeros(1 << bits, np.int32)
        for b in batches:
            for text in b.column(0).to_pylist():
                s = shingle_set(text, k, hashes)
                if len(s):
                    np.add.at(total, (s & np.uint64((1 << bits) - 1)).astype(np.int64), 1)
        if total.any():
            rows = total.astype("<i4", copy=False).view(np.uint8).reshape(-1, width, 4)
            for i in range(0, len(rows), 64):
                ids = range(i, min(i + 64, len(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([zlib.compress(rows[j].T.tobytes(), 1) for j in ids], pa.binary())], ["block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, width).T).view("<i4").ravel()
                total[i] = total[i] + part if i in total else part.astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([level(v).tobytes() for v in total.values()], pa.binary())], ["block", "counts"])

    parts = docs.select(F.col("text").cast("binary")).mapInArrow(tidied(count), "block int, counts binary")
    out = np.zeros(1 << bits, "<u2")
    with released(docs.sparkSession):
        got = parts.repartition(F.col("block")).mapInArrow(add, "block int, counts binary").toArrow()
    for i, raw in zip(got.column("block").to_pylist(), got.column("counts").to_pylist(), strict=True):
        out[i * width : (i + 1) * width] = np.frombuffer(raw, "<u2")
    return out


def base_prefix(n, percent: int = PERCENT):
    """Prefix that shares at least one element with every similar set."""
    return n - (percent * n + 99) // 100 + 1


def choose_extra(counts: np.ndarray, base: int, noise: float, most: int) -> int:
    """l - 1: how much longer the prefix gets. Cost is the rows that its elements meet, plus the share to verify."""
    load = np.maximum(counts[: base + most] - noise, 0)
    rows = np.cumsum(load)[base - 1 :]
    cost = rows * (1 + VERIFY_WEIGHT / np.arange(1, len(rows) + 1))
    return int(np.argmin(cost))


def signatures(docs: DataFrame, levels: np.ndarray, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, hash of the text, n, digest of the set (h1, h2), l and the prefix, rare shingles first."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(levels)  # 2**bits levels
    low_bits = np.uint64(len(levels) - 1)
    mean = sum(float(counted(part).sum()) for part in np.split(levels, max(1, len(levels) >> 16))) / len(levels)
    noise = mean + 4 * mean**0.5 + 1

    def run(batches):
        levels, hashes = shared.value, WordHashes()
        for b in batches:
            n, h1, h2, ell, prefix = [], [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(text, k, hashes)
                n.append(len(s))
                if not len(s):
                    h1.append(None)
                    h2.append(None)
                    ell.append(0)
                    prefix.append(np.empty(0, np.int64))
                    continue
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                h1.append((d >> 64) - (1 << 63))
                h2.append((d & (1 << 64) - 1) - (1 << 63))
                c = levels[(s & low_bits).astype(np.int64)]
                order = np.argsort(c, kind="stable")
                base = base_prefix(len(s), percent)
                most = min(LONGEST_EXTRA, len(s) - base)
                extra = choose_extra(counted(c[order[: base + most]]), base, noise, most)
                ell.append(extra + 1)
                prefix.append(s[order[: base + extra]].view(np.int64))
            sizes = np.fromiter(map(len, prefix), np.int64, len(prefix))
            flat = pa.array(np.concatenate(prefix) if prefix else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ell, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)],
                ["doc_id", "th", "n", "h1", "h2", "ell", "prefix"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text"), F.col("text").cast("binary")).mapInArrow(tidied(run), f"doc_id {kind}, th long, n long, h1 long, h2 long, ell int, prefix array<long>")


def _pairs(doc: np.ndarray, info: np.ndarray, percent: int) -> list[np.ndarray] | None:
    """Pairs inside rows of a matrix (documents that share a shingle) that pass the filters, with what they must share."""
    i, j = np.triu_indices(doc.shape[1], 1)
    x, y, fx, fy = (m[:, c].ravel() for m, c in ((doc, i), (doc, j), (info, i), (info, j)))
    nx, ny = fx >> 32, fy >> 32
    ok = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
    x, y, fx, fy, nx, ny = (v[ok] for v in (x, y, fx, fy, nx, ny))
    ix, iy = (fx >> 6) & 0x3FFFFFF, (fy >> 6) & 0x3FFFFFF
    overlap = (percent * (nx + ny) + 99 + percent) // (100 + percent)
    ok = np.minimum(ix, iy) + 1 + np.minimum(nx - ix - 1, ny - iy - 1) >= overlap
    rest = np.maximum(nx - base_prefix(nx, percent) - (fx & 63) + 1, ny - base_prefix(ny, percent) - (fy & 63) + 1)
    need = np.maximum(overlap - rest, 1)
    return [v[ok] for v in (np.minimum(x, y), np.maximum(x, y), need)]


def shared_shingles(batches, percent: int, most: int):
    """Edges from rows (key, doc, info) that are sorted by key: (a, b, need), need 0 in the star of a frequent key."""
    pending = [np.empty(0, np.int64)] * 3
    star = None  # (key, centre) of a frequent key that is still coming in

    def spokes(centre, docs):
        return [np.minimum(docs, centre), np.maximum(docs, centre), np.zeros(len(docs), np.int64)]

    def closed(rows):
        key, doc, info = rows
        if not len(key):
            return
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        sizes = np.diff(np.append(starts, len(key)))
        for m in np.unique(sizes):
            at = starts[sizes == m]
            if m == 1:
                continue
            if m > most:
                for s in at:
                    yield spokes(doc[s], doc[s + 1 : s + m])
                continue
            step = max(1, 2_000_000 // (m * m))
            for k in range(0, len(at), step):
                cells = at[k : k + step, None] + np.arange(m)
                yield _pairs(doc[cells], info[cells], percent)

    def batch(edges):
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in edges], ["a", "b", "need"])

    for b in batches:
        rows = [np.concatenate([p, c.to_numpy(zero_copy_only=False)]) for p, c in zip(pending, b.columns, strict=True)]
        if star and len(rows[0]):
            n = int((rows[0] == star[0]).sum())  # sorted, so they lead
            if n:
                yield batch(spokes(star[1], rows[1][:n]))
                rows = [r[n:] for r in rows]
            if len(rows[0]):
                star = None
        if not len(rows[0]):
            pending = rows
            continue
        last = len(rows[0]) - int((rows[0] == rows[0][-1]).sum())
        for edges in closed([r[:last] for r in rows]):
            if len(edges[0]):
                yield batch(edges)
        pending = [r[last:] for r in rows]
        if len(pending[0]) > most:
            star = (pending[0][0], pending[1][0])
            yield batch(spokes(star[1], pending[1][1:]))
            pending = [np.empty(0, np.int64)] * 3
    for edges in closed(pending):
        if len(edges[0]):
            yield batch(edges)


def link(sets: list[np.ndarray], percent: int, only_across: int | None = None) -> list[int]:
    """Root (lowest number reachable) of every set, from all links; with only_across, links between [0, a) and the rest."""
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(sets) == 2:
        c = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [0, 0] if 100 * c >= percent * (sizes.sum() - c) and c else [0, 1]
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    by_id = np.argsort(ids, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[by_id]
    first = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    at = 0
    for i, n in enumerate(sizes):
        mine = ids[at : at + n]
        at += n
        if only_across is not None and i >= only_across:
            break
        count = first[mine + 1] - first[mine]
        mine, count = mine[count > 1], count[count > 1]
        if not len(mine):
            continue
        ends = np.cumsum(count)
        where = np.arange(ends[-1]) + np.repeat(first[mine] - ends + count, count)
        both = np.bincount(owner[where], minlength=len(sets))
        hit = np.flatnonzero((both > 0) & (100 * both >= percent * (n + sizes - both)))
        for j in hit[hit > i]:
            if only_across is None or j >= only_across:
                a, b = find(i), find(int(j))
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def clusters_linked(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) edges that span the linked documents of every (root, part, other); rows have doc, h1, text and side."""

    def run(batches):
        hashes = WordHashes()
        held: list[tuple] = []
        key = None

        def solve():
            if len(held) < 2:
                return
            held.sort(key=lambda r: (r[2], r[0]))
            docs, sets = [r[0] for r in held], [r[1] for r in held]
            across = sum(r[2] == 0 for r in held) if held[0][2] != held[-1][2] else None
            roots = link(sets, percent, across)
            edges = [(docs[r], d) for d, r in zip(docs, roots, strict=True) if docs[r] != d]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], ["a", "b"])

        for b in batches:
            for root, part, other, side, doc, h1, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (root, part, other) != key:
                    yield from solve()
                    held.clear()
                    key = (root, part, other)
                s = shingle_set(text, k, hashes)
                if (xxhash.xxh3_128_intdigest(s.tobytes()) >> 64) - (1 << 63) == h1:
                    held.append((doc, s, side))
        yield from solve()

    cols = ["root", "part", "other", "side", "doc", "h1", "text"]
    return rows.select(cols).repartition("root", "part", "other").sortWithinPartitions("root", "part", "other").mapInArrow(tidied(run), "a long, b long")


def _candidates(docs: DataFrame, k: int, percent: int, most: int, keep, save) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes and digests of the rows, their classes (node, h1, h2, least, n), and the classes' candidate clusters (root).

    Prefixes take most of the room: those of rows go once classes have them, those of classes once pairs are found.
    """
    with Kept(docs.sparkSession) as wide:
        with Kept(docs.sparkSession) as every:
            full = every(signatures(docs, sketch(docs, k), k, percent))
            named = full.where("n > 0 and doc_id is not null")
            reps = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.first(F.struct("n", "ell", "prefix")).alias("s"))
            reps = wide(reps.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "least", "s.*"))
            sigs = save(full.drop("ell", "prefix"))
        exploded = reps.select("node", "n", "ell", F.posexplode("prefix").alias("i", "key"))
        info = F.shiftleft("n", 32).bitwiseOR(F.shiftleft(F.col("i").cast("long"), 6)).bitwiseOR(F.col("ell").cast("long"))
        keyed = exploded.select("key", "node", info.alias("info")).repartition(F.col("key")).sortWithinPartitions("key")
        edges = keyed.mapInArrow(tidied(lambda it: shared_shingles(it, percent, most)), "a long, b long, need long")
        pairs = edges.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("need").alias("low"), F.max("need").alias("need"))
        near = keep(pairs.where("low = 0 or c >= need").select("a", "b"))
        reps = save(reps.drop("ell", "prefix"))
    cluster = components(near, keep)
    return sigs, reps, keep(cluster.join(reps, "node").select("node", "root", "h1", "h2", "least", "n"))


def _large(sized: DataFrame, most: int) -> DataFrame:
    """root and t, the shingles of its classes, of the clusters over a bound."""
    return sized.groupBy("root").agg(F.sum("n").alias("t")).where(F.col("t") > most)


def narrowed(docs: DataFrame, sized: DataFrame, k: int, percent: int, most: int, cluster_shingles: int, keep) -> DataFrame:
    """The clusters `sized`, those over the bound replaced by what a search among their own documents makes of them.

    All links of a cluster's documents lie inside it, so the search finds them again, in smaller clusters if it can.
    """
    before = None
    for _ in range(AGAIN):
        large = keep(_large(sized, cluster_shingles))
        total = large.agg(F.sum("t")).first()[0]
        if total is None or before is not None and 2 * total > before:
            break
        before = total
        over = keep(sized.join(large.select("root"), "root", "left_semi"))
        # other documents that the flags let through find no class in `over`
        own = docs.where(F.coalesce(maybe_in(flags(over, "least", BITMAP_BITS, keep), "doc_id", BITMAP_BITS), F.lit(False)))
        fine = _candidates(own, k, percent, most, keep, keep)[2].select("h1", "h2", F.col("root").alias("fine"))
        fine = keep(over.drop("root").join(fine, ["h1", "h2"]))
        # a cluster's root is one of its nodes, so it can't be another's
        named = fine.join(fine.groupBy("fine").agg(F.min("node").alias("root")), "fine").select(sized.columns)
        sized = keep(sized.join(large.select("root"), "root", "left_anti").select(sized.columns).unionByName(named))
    return sized


def _joined(docs: DataFrame, k: int, percent: int, most: int, cluster_shingles: int) -> DataFrame:
    """doc_id, hash of the text, n_shingles, component_id of every row.

    Equal sets are one class, and classes are numbered: a doc_id that is repeated with another text is another class.
    """
    with Kept(docs.sparkSession) as keep:
        sigs, reps, sized = _candidates(docs, k, percent, most, keep, keep)
        sized = narrowed(docs, sized, k, percent, most, cluster_shingles, keep)
        found = keep(_verified(docs, sized, k, percent, cluster_shingles, keep))
        roots = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).groupBy("node").agg(F.min("root").alias("root"))
        linked = keep(roots.join(reps.select("node", "least"), "node"))
        low = linked.groupBy("root").agg(F.min("least").alias("low"))
        labels = linked.join(low, "root").select("node", "low")
        classes = reps.select("node", "h1", "h2", "least").join(labels, "node", "left").select("h1", "h2", F.coalesce("low", "least").alias("component_id"))
        out = ["doc_id", "th", F.col("n").alias("n_shingles"), "component_id"]
        alone = sigs.where("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id")).select(out)
        return stored(sigs.where("n > 0 and doc_id is not null").join(classes, ["h1", "h2"]).select(out).unionByName(alone))


def _verified(docs: DataFrame, sized: DataFrame, k: int, percent: int, cluster_shingles: int, keep) -> DataFrame:
    """(node, root) of the classes that have links, from the candidate clusters' texts."""
    # clusters over the bound are cut into blocks; block i meets every block j >= i
    big = keep(_large(sized, cluster_shingles).select("root", F.ceil(F.col("t") / (cluster_shingles // 2)).cast("int").alias("blocks")))
    split = not big.isEmpty()
    placed = sized.select(F.col("node").alias("doc"), "root", "h1", "least")
    if split:
        placed = placed.join(big, "root", "left").withColumn("own", F.expr("cast(pmod(xxhash64(doc), coalesce(blocks, 1)) as int)"))
        meet = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda j: F.struct(F.least("own", j).alias("part"), F.greatest("own", j).alias("other"), (F.col("own") > j).cast("int").alias("side")))
        placed = placed.withColumn("m", F.explode(meet)).select("doc", "root", "h1", "least", "m.*")
    else:
        zero = F.lit(0)
        placed = placed.select("doc", "root", "h1", "least", zero.alias("part"), zero.alias("other"), zero.alias("side"))
    wanted = F.coalesce(maybe_in(flags(sized, "least", BITMAP_BITS, keep), "doc_id", BITMAP_BITS), F.lit(False))
    texts = docs.where(wanted).select(F.col("doc_id").alias("least"), F.col("text").cast("binary").alias("text"))
    spans = keep(clusters_linked(placed.join(texts, "least"), k, percent))
    return components(spans, keep) if split else spans.select(F.col("b").alias("node"), F.col("a").alias("root"))


def join(docs: DataFrame, k: int = K, percent: int = PERCENT, most: int = MOST, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return _joined(docs, k, percent, most, cluster_shingles).drop("th")


def first_of_each(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The documents without those whose component has a smaller doc_id; empty sets and null ids stay.

    Rows go by doc_id and text, so another text under the same doc_id is judged on its own.
    """
    rows = _joined(docs.select("doc_id", "text"), k, percent, MOST, CLUSTER_SHINGLES)
    later = rows.where("component_id < doc_id").select(F.col("doc_id").alias("_later"), F.col("th").alias("_text")).distinct()
    return docs.join(later, (F.col("doc_id") == F.col("_later")) & (F.xxhash64("text") == F.col("_text")), "left_anti")
