"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Vectors are dealt to shards by hash. A shard's graph is built in growing batches: a greedy beam search from the medoid
proposes neighbours for every new vector, relaxed distance pruning keeps edges that lead in different directions (a
candidate goes if a kept one is nearer to it than the vector itself by the factor `ALPHA`), and reverse edges are
pruned the same way. Queries stream through every shard in blocks and are answered by beam search; a shard returns
its k nearest with exact distances in double precision, and the k nearest over all shards remain.

Equal vectors are one node; its k + 1 smallest ids are all that a query can ever be given of it, so nothing is lost.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
another dimension are never compared; rows repeating a vec_id count once (for a query: the smallest vector; as a
candidate: its nearest vector); ties go to the smaller vec_id; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEGREE = 32
BEAM = 64
QUERY_BEAM = 384
ALPHA = 1.2
SHARD_VECTORS = 25_000
K = 10
QUERY_BLOCK = 256


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows x (b, d) to y (b, m, d)."""
    diff = y - x[:, None, :]
    return np.einsum("bmd,bmd->bm", diff, diff)


class PrunedGraph:
    """Out-neighbours of every vector in a fixed-width table, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7):
        self.x, self.degree, self.alpha = np.ascontiguousarray(vectors, np.float32), degree, alpha
        n = len(self.x)
        self.out = np.full((n, degree), -1, np.int32)
        self.entry = int(np.argmin(((self.x - self.x.mean(0)) ** 2).sum(1)))
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        at, size = 1, 1
        while at < n:
            batch = order[at : at + size]
            self._insert(batch, beam)
            at += size
            size = min(256, max(1, at // 4))

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query: the beam's ids and squared distances, nearest first, and all expanded ids (-1: none)."""
        q = np.ascontiguousarray(queries, np.float32)
        b, rows = len(q), np.arange(len(q))
        ids = np.full((b, beam), -1, np.int32)
        dist = np.full((b, beam), np.inf, np.float32)
        done = np.ones((b, beam), bool)
        seen = np.zeros((b, len(self.x)), bool)
        ids[:, 0], done[:, 0], seen[:, self.entry] = self.entry, False, True
        dist[:, 0] = _squares(q, np.broadcast_to(self.x[self.entry], (b, 1, q.shape[1])))[:, 0]
        path = []
        live = rows
        while True:
            todo = ~done[live]
            has = todo.any(1)
            live = live[has]
            if not len(live):
                break
            k = np.argmax(todo[has], axis=1)  # the beam is sorted: first open entry is the nearest
            node = ids[live, k]
            done[live, k] = True
            step = np.full(b, -1, np.int32)
            step[live] = node
            path.append(step)
            near = self.out[node]
            fresh = near >= 0
            safe = np.where(fresh, near, 0)
            fresh &= ~seen[live[:, None], safe]
            r, c = np.nonzero(fresh)
            seen[live[r], safe[r, c]] = True
            d = np.full(near.shape, np.inf, np.float32)
            diff = self.x[safe[r, c]] - q[live[r]]
            d[r, c] = np.einsum("md,md->m", diff, diff)
            all_d = np.concatenate([dist[live], d], 1)
            all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(all_d, best, 1)
            ids[live] = np.take_along_axis(all_i, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1)
        return ids, dist, np.stack(path, 1)

    def _prune(self, nodes: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Robust pruning of candidate lists (-1: none) to `degree` edges for each node."""
        cand = np.where(cand == nodes[:, None], -1, cand)
        # a candidate listed twice counts once
        by_id = np.sort(cand, 1)
        by_id[:, 1:][by_id[:, 1:] == by_id[:, :-1]] = -1
        cand = by_id
        d = np.where(cand >= 0, _squares(self.x[nodes], self.x[np.maximum(cand, 0)]), np.inf)
        order = np.argsort(d, 1, kind="stable")[:, : max(4 * self.degree, 1)]
        cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
        y = self.x[np.maximum(cand, 0)]
        sq = np.einsum("bmd,bmd->bm", y, y)
        between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(y, y.transpose(0, 2, 1))
        alive = np.isfinite(d)
        out = np.full((len(nodes), self.degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for k in range(self.degree):
            if not alive.any():
                break
            j = np.argmax(alive, 1)
            ok = alive[rows, j]
            out[ok, k] = cand[rows, j][ok]
            alive[rows, j] = False
            alive &= ~(ok[:, None] & (self.alpha**2 * between[rows, j] <= d))
        return out

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        _, _, path = self.search(self.x[batch], beam)
        self.out[batch] = self._prune(batch, path)
        src = np.repeat(batch, self.degree)
        dst = self.out[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, start, count = np.unique(dst, return_index=True, return_counts=True)
        extra = np.full((len(nodes), count.max()), -1, np.int32)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(dst)) - np.repeat(start, count)] = src
        have = self.out[nodes]
        room = (have >= 0).sum(1) + count <= self.degree
        for i in np.flatnonzero(room):
            k = (have[i] >= 0).sum()
            self.out[nodes[i], k : k + count[i]] = extra[i, : count[i]]
        full = np.flatnonzero(~room)
        if len(full):
            self.out[nodes[full]] = self._prune(nodes[full], np.concatenate([have[full], extra[full]], 1))


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, shard_vectors: int = SHARD_VECTORS, beam: int = QUERY_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows but itself; both frames have vec_id and embedding."""
    cols = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")]
    base = rows.where("vec_id is not null").select(*cols).where(usable(F.col("v")))
    asked = queries.where("vec_id is not null").select(*cols).where(usable(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = int(max(1, -(-rows.count() // shard_vectors)))
    # the k + 1 smallest ids of a vector: the limit is applied before the shuffle too
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = base.distinct().withColumn("_p", place).where(F.col("_p") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    dim = F.size("v")
    built = nodes.select(F.expr(f"cast(pmod(xxhash64(v), {shards}) as int)").alias("shard"), dim.alias("dim"), F.lit(0).alias("kind"), "ids", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), dim.alias("dim"), F.lit(1).alias("kind"), F.array("vec_id").alias("ids"), "v")

    def run(batches):
        key, ids, vectors, graph, block, x, scale = None, [], [], None, [], None, 1.0

        def answer():
            """The block's queries, k rows each."""
            nonlocal block
            q = np.stack([v for _, v in block])
            found, _, _ = graph.search(q / scale, max(beam, k + 1))
            qs, vs, ds = [], [], []
            for (qid, v), near in zip(block, found, strict=True):
                near = near[near >= 0]
                exact = np.sqrt(((x[near] - v) ** 2).sum(1))
                best = sorted((d, i) for d, node in zip(exact.tolist(), near, strict=True) for i in ids[node] if i != qid)[:k]
                qs += [qid] * len(best)
                vs += [i for _, i in best]
                ds += [d for d, _ in best]
            block = []
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(vs, pa.int64()), pa.array(ds, pa.float64())], ["query_id", "vec_id", "score"])

        for b in batches:
            flat = b.column(4).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(b.column(1).to_numpy())
            for i, (shard, d, kind) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if (shard, d) != key:
                    if block:
                        yield from answer()
                    key, ids, vectors, graph = (shard, d), [], [], None
                v = flat[ends[i] - d : ends[i]]
                if kind == 0:
                    ids.append(b.column(3)[i].as_py())
                    vectors.append(v.copy())
                elif vectors:
                    if graph is None:
                        # the graph is in single precision, scaled so that nothing overflows; distances aren't
                        x, vectors = np.stack(vectors), [True]
                        scale = float(np.abs(x).max())
                        graph = PrunedGraph(x / scale)
                    block.append((b.column(3)[i][0].as_py(), v.copy()))
                    if len(block) == QUERY_BLOCK:
                        yield from answer()
        if block:
            yield from answer()

    # the first number that Spark's hash sends to each partition: so every shard has a partition of its own
    slot = rows.sparkSession.range(32 * shards).groupBy(F.expr(f"pmod(hash(id), {shards})").alias("shard")).agg(F.min("id").alias("slot"))
    dealt = built.unionByName(sent).join(slot, "shard", "left").select("shard", "dim", "kind", "ids", "v", F.coalesce("slot", F.col("shard").cast("long")).alias("slot"))
    dealt = dealt.repartition(shards, "slot").sortWithinPartitions("shard", "dim", "kind").drop("slot")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
