"""Differential regions: spatially combined p-values, region calling, and annotation.

Calling follows the published method (Kechris et al. 2010; Pedersen et al. 2012): autocorrelation of the p-values'
scores by distance, Stouffer-Liptak combination of each site with its neighbours, Benjamini-Hochberg, regions of
significant sites at most `dist` apart, and a Sidak-corrected p per region.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nearest_ten
from ..storage import stored
from .aggregate import extremes, joined_names

_NORMAL = NormalDist()


def _score(p: np.ndarray) -> np.ndarray:
    """z of upper-tail p-values, which are kept off 0 and 1."""
    values, back = np.unique(np.clip(p, 1e-16, 1 - 1e-12), return_inverse=True)
    return np.array([-_NORMAL.inv_cdf(x) for x in values.tolist()])[back]


@F.pandas_udf(T.DoubleType())
def z_score(p: pd.Series) -> pd.Series:
    return pd.Series(_score(p.to_numpy(float)))


def autocorrelation(sites: DataFrame, by: list[str], step: int, dist: int) -> DataFrame:
    """Correlation of the scores of sites whose distance falls into each step up to `dist`: (by, lag, r).

    Sites meet neighbours through position bins of `dist`, so pairs are only those within reach.
    """
    z = sites.select(*by, "pos", "z").withColumn("_bin", F.floor(F.col("pos") / dist))
    left = z.select(*by, F.col("pos").alias("p1"), F.col("z").alias("z1"), "_bin")
    right = z.select(*by, F.col("pos").alias("p2"), F.col("z").alias("z2"), F.explode(F.array(F.col("_bin"), F.col("_bin") - 1)).alias("_bin"))
    pairs = left.join(right, [*by, "_bin"]).where((F.col("p2") > F.col("p1")) & (F.col("p2") - F.col("p1") <= dist))
    lag = F.floor((F.col("p2") - F.col("p1") - 1) / step).cast("int")
    return pairs.groupBy(*by, lag.alias("lag")).agg(F.greatest(F.coalesce(F.corr("z1", "z2"), F.lit(0.0)), F.lit(0.0)).alias("r"))


def combine(sites: DataFrame, acf: DataFrame, by: list[str], step: int, dist: int) -> DataFrame:
    """Adds combined_p: Stouffer-Liptak over the sites within `dist`, their correlations taken from acf.

    Position bins that carry a margin of `dist` from their neighbours are computed apart, so a long dimension value is
    many tasks; no site's neighbourhood is written out.
    """
    width, lags = max(100 * dist, 10_000), -(-dist // step)
    table = acf.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("lag", "r"))).alias("_acf"))
    by_lag = F.transform(F.sequence(F.lit(0), F.lit(lags - 1)), lambda k: F.coalesce(F.try_element_at(F.col("_acf"), k), F.lit(0.0)))
    first, final = F.floor((F.col("pos") - dist) / width), F.floor((F.col("pos") + dist) / width)
    spread = sites.withColumn("_own", F.floor(F.col("pos") / width)).withColumn("_bin", F.explode(F.sequence(first, final)))
    rows = spread.join(F.broadcast(table), by, "left").select(*sites.columns, "_own", "_bin", by_lag.alias("_r"))
    names = sites.columns

    def own(bin: pd.DataFrame) -> pd.DataFrame:
        bin = bin.sort_values("pos", kind="stable")
        mine = (bin["_own"] == bin["_bin"]).to_numpy()
        r = bin["_r"].iloc[0]
        p = combined(bin["pos"].to_numpy(np.int64), bin["z"].to_numpy(float), mine, [0.0] * lags if r is None else r, step, dist)
        return bin.loc[mine, names].assign(combined_p=p)

    return rows.groupBy(*by, "_bin").applyInPandas(own, T.StructType([*sites.schema.fields, T.StructField("combined_p", T.DoubleType())]))


def combined(pos: np.ndarray, z: np.ndarray, mine: np.ndarray, by_lag, step: int, dist: int) -> np.ndarray:
    """stouffer_liptak() of the sites within `dist` of each site that is `mine`, from sorted positions.

    The pairs up to a lag are counted by running sums: a site's partners before it are those within the lag, or those
    from the neighbourhood's first site on where that one is nearer.
    """
    at = pos[mine]
    if not len(at):
        return np.empty(0)
    a, b = np.searchsorted(pos, at - dist, "left"), np.searchsorted(pos, at + dist, "right")
    score = np.add.reduceat(np.append(z, 0.0), np.stack([a, b], 1).ravel())[::2]
    spread, before = (b - a).astype(float), 0
    for c, r in enumerate(by_lag):
        low = np.searchsorted(pos, pos - (c + 1) * step, "left")
        partners = np.concatenate([[0], np.cumsum(np.arange(len(pos)) - low)])
        full = np.minimum(np.searchsorted(low, a, "left"), b)  # from this site on, all partners lie in the neighbourhood
        within = (full - a) * (full - a - 1) // 2 + partners[b] - partners[full]
        spread += 2 * r * (within - before)
        before = within
    return np.array([0.5 * math.erfc(t / math.sqrt(2 * max(v, 1e-12))) for t, v in zip(score, spread, strict=True)])


def stouffer_liptak_all(pos, z, by_lag, step: int) -> np.ndarray:
    """stouffer_liptak() of many neighbourhoods at once.

    All positions lie in one array, each neighbourhood behind the one before at a distance that no lag bridges; the
    pairs up to a lag are then counted by one binary search for all positions, not looked at one by one.
    """
    sizes = np.fromiter(map(len, pos), np.int64, len(pos))
    out = np.ones(len(pos))
    own = np.flatnonzero(sizes)
    if not len(own):
        return out
    sizes, starts = sizes[own], np.concatenate([[0], np.cumsum(sizes[own])[:-1]])
    flat = np.concatenate([np.asarray(pos[k], np.int64) for k in own])
    score = np.add.reduceat(np.concatenate([np.asarray(z[k], float) for k in own]), starts)
    r = np.stack([np.asarray(by_lag[k], float) for k in own])
    low = np.minimum.reduceat(flat, starts)
    flat -= np.repeat(low, sizes)
    apart = int(flat.max()) + r.shape[1] * step + 1
    flat = np.sort(flat + np.repeat(np.arange(len(own)) * apart, sizes))
    spread, before = sizes.astype(float), 0
    for c in range(r.shape[1]):
        within = np.add.reduceat(np.arange(len(flat)) - np.searchsorted(flat, flat - (c + 1) * step, "left"), starts)
        spread += 2 * r[:, c] * (within - before)
        before = within
    out[own] = [0.5 * math.erfc(t / math.sqrt(2 * max(v, 1e-12))) for t, v in zip(score, spread, strict=True)]
    return out


def stouffer_liptak(pos, z, by_lag, step: int) -> float:
    """p of the sum of correlated scores: their variances and, by distance, correlations add up to the sum's variance."""
    return float(stouffer_liptak_all([pos], [z], [by_lag], step)[0])


def adjust(rows: DataFrame, by: list[str], p: str, out: str) -> DataFrame:
    """Benjamini-Hochberg: least of p * n / rank over this and all larger p.

    Ranks come from distinct p-values and their counts, so only those are sorted in one task per group.
    """
    times = rows.groupBy(*by, p).agg(F.count("*").alias("_k"))
    so_far = lambda order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.sum("_k").over(so_far(F.asc(p)))
    raw = times.withColumn("_raw", F.col(p) * F.sum("_k").over(Window.partitionBy(*by)) / rank)
    best = raw.withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(so_far(F.desc(p))))).select(*by, p, out)
    return rows.join(best, [*by, p])


def clusters(rows: DataFrame, by: list[str], dist: int, width: int = 65_536) -> DataFrame:
    """Adds `cluster`: rows at most `dist` after the one before belong together.

    Clusters are counted inside blocks of positions; a block whose first row is near the last one of the block before
    goes on with its cluster. What is ordered in one task is one row a block.
    """
    inside = Window.partitionBy(*by, "_b").orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(inside) <= dist, 0).otherwise(1)
    counted = rows.withColumn("_b", F.floor(F.col("pos") / width)).withColumn("_new", new)
    counted = counted.withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = counted.groupBy(*by, "_b").agg(F.max("_run").alias("_n"), F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    along = Window.partitionBy(*by).orderBy("_b")
    blocks = blocks.withColumn("_on", F.when(F.col("_first") - F.lag("_last").over(along) <= dist, 1).otherwise(0))
    before = F.coalesce(F.sum(F.col("_n") - F.col("_on")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = blocks.select(*by, "_b", (before - F.col("_on")).alias("_shift"))
    return counted.join(shifts, [*by, "_b"]).select(*rows.columns, (F.col("_run") + F.col("_shift")).cast("long").alias("cluster"))


def call_regions(sites: DataFrame, by: list[str], dist: int = 300, step: int | None = None, seed: float = 0.05) -> DataFrame:
    """(by, start, end, n_probes, min_p, z_p, z_sidak_p) from sites (by, pos, pval)."""
    step = step or max(nearest_ten(dist), 1)
    # scores and combined p-values are read by several branches each: made once, in the shared folder
    z = stored(sites.where("pval is not null").select(*by, "pos", z_score("pval").alias("z")))
    acf = stored(autocorrelation(z, by, step, dist))
    combined = stored(combine(z, acf, by, step, dist).select(*by, "pos", "z", "combined_p"))
    adjusted = adjust(combined, by, "combined_p", "q")
    groups = clusters(adjusted.where(F.col("q") <= seed), by, dist).groupBy(*by, "cluster")
    found = groups.agg(F.min("pos").alias("_a"), F.max("pos").alias("_b"), F.count("*").alias("n_probes"), F.min("q").alias("min_p"), F.sort_array(F.collect_list(F.struct("pos", "z"))).alias("_n"))
    total = z.groupBy(*by).agg(F.count("*").alias("_total"))
    table = acf.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("lag", "r"))).alias("_acf"))
    lags = -(-dist // step)

    @F.pandas_udf(T.DoubleType())
    def region_p(ps: pd.Series, zs: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(stouffer_liptak_all(ps, zs, [v if v is not None else [0.0] * lags for v in r], step))

    by_lag = F.transform(F.sequence(F.lit(0), F.lit(lags - 1)), lambda k: F.coalesce(F.try_element_at(F.col("_acf"), k), F.lit(0.0)))
    out = found.join(total, by).join(table, by, "left").withColumn("z_p", region_p(F.col("_n.pos"), F.col("_n.z"), by_lag))
    sidak = 1 - F.pow(1 - F.least("z_p", F.lit(1.0)), F.col("_total") / F.col("n_probes"))
    return out.select(*by, (F.col("_a") - 1).alias("start"), F.col("_b").alias("end"), "n_probes", "min_p", "z_p", sidak.alias("z_sidak_p"))


def significant(dmrs: DataFrame, limit: float = 0.05) -> DataFrame:
    return dmrs.where(F.col("z_sidak_p") <= limit)


def annotate(matrix: DataFrame, dmrs: DataFrame, keys: list[str], value: str = "beta", cutoff: float | None = None) -> DataFrame:
    """keys, Hypo, Hyper, Max, Min, delta_beta, n_dms, sname of each region of a long matrix (keys, sample, value).

    n_dms is that of the last sname if a region is listed several times; regions without DMR have nulls.
    """
    ends = extremes(matrix, keys, value)
    probes = dmrs.groupBy(*keys).agg(F.max_by("n_dms", "sname").alias("n_dms"))
    names = joined_names(dmrs, keys, "sname")
    out = ends.join(probes, keys, "left").join(names, keys, "left")
    out = out.select(*keys, "Hypo", "Hyper", "Max", "Min", "delta_beta", "n_dms", "sname")
    return out if cutoff is None else out.where(F.col("delta_beta") >= cutoff)
