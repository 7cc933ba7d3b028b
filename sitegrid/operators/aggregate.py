"""Sums across samples, classes, regions and strand pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import saturate
from ..model import ordinals
from .join import by_id_intervals, with_class


def merge_samples(m: DataFrame, keys: list[str], values: list[str], formats: list[str] | None = None) -> DataFrame:
    """Sum of each value over the rows of a key, saturated to the formats if given. Sums are made before the shuffle too."""
    formats = formats or ["q"] * len(values)
    return m.groupBy(*keys).agg(*(saturate(F.sum(v), f).alias(v) for v, f in zip(values, formats, strict=True)))


def merge_classes(m: DataFrame, classes: DataFrame, keys: list[str], values: list[str], formats: list[str] | None = None, key: str = "sample") -> DataFrame:
    """merge_samples per class."""
    own = next(c for c in classes.columns if c != key)
    return merge_samples(with_class(m, classes, key), [own, *keys], values, formats)


def running_sums(df: DataFrame, dims: list[str], values: list[str], block: int = 65_536) -> DataFrame:
    """(dims, id, sums up to and with that row). Blocks of ids are summed apart, then moved by the blocks before."""
    cut = df.select(*dims, "id", *values).withColumn("_b", F.floor(F.col("id") / block))
    inside = Window.partitionBy(*dims, "_b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*dims).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*dims, "_b").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    totals = totals.select(*dims, "_b", *(F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_t_{v}") for v in values))
    rows = cut.select(*dims, "_b", "id", *(F.sum(v).over(inside).alias(v) for v in values))
    return rows.join(totals, [*dims, "_b"]).select(*dims, "id", *((F.col(v) + F.col(f"_t_{v}")).alias(v) for v in values))


def region_sums(df: DataFrame, index: DataFrame, dims: list[str], values: list[str], formats: list[str] | None = None) -> DataFrame:
    """Sum of each value over the rows of each id interval: running sums at its two ends, two equi-joins.

    The ids must be dense, as assign_ids makes them. An interval's end beyond the last row counts up to that row.
    """
    formats = formats or ["q"] * len(values)
    sums = running_sums(df, dims, values)
    last = df.groupBy(*dims).agg(F.max("id").alias("_last"))
    own = [c for c in index.columns if c not in dims]
    ends = index.join(last, dims).withColumn("_end", F.least("id_end", "_last")).where("id_start <= _end")
    upper = sums.select(*dims, F.col("id").alias("_end"), *(F.col(v).alias(f"_u_{v}") for v in values))
    lower = sums.select(*dims, (F.col("id") + 1).alias("id_start"), *(F.col(v).alias(f"_l_{v}") for v in values))
    both = ends.join(upper, [*dims, "_end"]).join(lower, [*dims, "id_start"], "left")
    return both.select(*dims, *own, *(saturate(F.col(f"_u_{v}") - F.coalesce(f"_l_{v}", F.lit(0)), f).alias(v) for v, f in zip(values, formats, strict=True)))


def region_sums_by_join(df: DataFrame, index: DataFrame, dims: list[str], values: list[str]) -> DataFrame:
    """The same by the binned interval join, for ids with gaps."""
    own = [c for c in index.columns if c not in dims]
    return by_id_intervals(df, index, dims).groupBy(*dims, *own).agg(*(F.sum(v).alias(v) for v in values))


def region_means(points: DataFrame, regions: DataFrame, dims: list[str], value: str, group: list[str] = (), width: int = 1024) -> DataFrame:
    """Mean of a value over the points contained in each region, per group."""
    from .join import points_in_intervals

    own = [c for c in regions.columns if c not in dims]
    return points_in_intervals(points, regions, dims, "pos", "start", "stop", width).groupBy(*dims, *own, *group).agg(F.avg(value).alias(value))


def strand_merge(df: DataFrame, dims: list[str], values: list[str], strict: bool = False) -> DataFrame:
    """Rows 2k-1 and 2k summed; an odd last row is dropped. strict: the pair must be neighbouring + and - positions."""
    pairs = ordinals(df, dims, "id", "_place").withColumn("_pair", F.floor((F.col("_place") - 1) / 2)).groupBy(*dims, "_pair")
    extra = [F.min("pos").alias("_a"), F.max("pos").alias("_b"), F.min_by("strand", "pos").alias("_s"), F.max_by("strand", "pos").alias("_t")] if strict else []
    out = pairs.agg(F.count("*").alias("_n"), *(F.sum(v).alias(v) for v in values), *extra).where("_n = 2")
    if strict:
        out = out.where("_b = _a + 1 and _s = '+' and _t = '-'")
    return out.select(*dims, (F.col("_pair") + 1).alias("id"), *values)


def site_totals(m: DataFrame, keys: list[str]) -> DataFrame:
    """mc_sum, cov_sum, uc_sum of a site over all samples, on every sample's row."""
    at = Window.partitionBy(*keys)
    out = m.withColumn("mc_sum", F.sum("mc").over(at)).withColumn("cov_sum", F.sum("cov").over(at))
    return out.withColumn("uc_sum", F.col("cov_sum") - F.col("mc_sum"))


def extremes(m: DataFrame, keys: list[str], value: str, name: str = "sample", order: Column | None = None) -> DataFrame:
    """Per key: Hypo and Hyper (samples of the least and greatest value; the first sample wins ties), Min, Max, delta_beta.

    A key with a NaN has NaN extremes, as arithmetic would give; nulls are ignored.
    """
    place = order if order is not None else F.col(name)
    bad = F.max(F.isnan(value))
    least = lambda v: F.min(F.struct(v.alias("s"), place.alias("o"), F.col(name).alias("n"), F.col(value).alias("v")))
    out = m.where(F.col(value).isNotNull()).groupBy(*keys).agg(least(F.col(value)).alias("_l"), least(-F.col(value)).alias("_h"), bad.alias("_bad"))
    nan = F.lit(float("nan"))
    return out.select(
        *keys, F.col("_l.n").alias("Hypo"), F.col("_h.n").alias("Hyper"), F.when(F.col("_bad"), nan).otherwise(F.col("_l.v")).alias("Min"),
        F.when(F.col("_bad"), nan).otherwise(F.col("_h.v")).alias("Max"), F.when(F.col("_bad"), nan).otherwise(F.col("_h.v") - F.col("_l.v")).alias("delta_beta"),
    )


def joined_names(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct names of a key, sorted and joined by commas."""
    return df.groupBy(*keys).agg(F.concat_ws(",", F.sort_array(F.collect_set(name))).alias(name))


def class_members(classes: DataFrame, key: str = "sample", own: str = "cell_class") -> DataFrame:
    """Samples of each class, sorted, as an array."""
    return classes.groupBy(own).agg(F.sort_array(F.collect_list(key)).alias("samples"))
