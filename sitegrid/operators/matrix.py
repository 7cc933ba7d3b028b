"""Sites-by-samples matrices and back. The long form is the model; a matrix is made at the edge, with its samples named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fisher_p, odds_ratio, safe_ratio, sig3
from .aggregate import site_totals
from .select import mask_unless_below


def _pivot(m: DataFrame, keys: list[str], samples: list[str], values: dict[str, Column]) -> DataFrame:
    """One column per sample and value, in the samples' order; a single unnamed value takes the sample's name."""
    cells = [F.max(F.when(F.col("sample") == s, v)).alias(s + suffix) for s in samples for suffix, v in values.items()]
    return m.groupBy(*keys).agg(*cells)


def sample_names(m: DataFrame) -> list[str]:
    """All samples, sorted: the columns of a matrix."""
    return sorted(r[0] for r in m.select("sample").distinct().collect())


def fraction(m: DataFrame, keys: list[str], samples: list[str], rounded: bool = True) -> DataFrame:
    """mc / cov of each sample, 0 without coverage, to three significant digits."""
    x = safe_ratio(F.col("mc"), F.col("cov"))
    return _pivot(m.select("sample", *keys, (sig3(x) if rounded else x).alias("v")), keys, samples, {"": F.col("v")})


def counts(m: DataFrame, keys: list[str], samples: list[str]) -> DataFrame:
    """<sample>.mc and <sample>.cov."""
    return _pivot(m, keys, samples, {".mc": F.col("mc"), ".cov": F.col("cov")})


def fisher_long(m: DataFrame, keys: list[str]) -> DataFrame:
    """Each sample against the rest of its site: odd_ratio and pval, not rounded."""
    t = site_totals(m, keys)
    a, b = F.col("mc"), F.col("cov") - F.col("mc")
    c, d = F.col("mc_sum") - a, F.col("uc_sum") - b
    return t.select("sample", *keys, odds_ratio(a, b, c, d).alias("odd_ratio"), fisher_p(a, b, c, d).alias("pval"))


def fisher(m: DataFrame, keys: list[str], samples: list[str], rounded: bool = True) -> DataFrame:
    """<sample>.odd_ratio and <sample>.pval."""
    rows = fisher_long(m, keys)
    if rounded:
        rows = rows.withColumn("odd_ratio", sig3("odd_ratio")).withColumn("pval", sig3("pval"))
    return _pivot(rows, keys, samples, {".odd_ratio": F.col("odd_ratio"), ".pval": F.col("pval")})


def with_reference(matrix: DataFrame, ref: DataFrame, dims: list[str]) -> DataFrame:
    """Reference coordinates in front: dims, start (pos - 1), pos, strand, context."""
    rest = [c for c in matrix.columns if c not in (*dims, "id")]
    return ref.join(matrix, [*dims, "id"]).select(*dims, (F.col("pos") - 1).alias("start"), "pos", "strand", "context", *(F.col(f"`{c}`") for c in rest))


def unpivot(matrix: DataFrame, keys: list[str], samples: list[str], masked: bool = True) -> DataFrame:
    """A Fisher matrix as rows (sample, keys, pval, odd_ratio); pval is masked to hypomethylation if asked."""
    cell = F.explode(F.array(*(F.struct(F.lit(s).alias("sample"), F.col(f"`{s}.pval`").alias("pval"), F.col(f"`{s}.odd_ratio`").alias("odd_ratio")) for s in samples)))
    rows = matrix.select(*keys, cell.alias("_c")).select("_c.sample", *keys, "_c.pval", "_c.odd_ratio")
    return mask_unless_below(rows) if masked else rows
