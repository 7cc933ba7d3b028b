"""Scalar functions: sequence context, rounding, ratios, Fisher's exact test, format codes, packed offsets.

All but `sig3`, `fisher_p` are JVM expressions; those two go through Arrow, because Spark has neither C-style
rounding to significant digits nor a log-gamma function.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# IUPAC nucleotide codes and their complements.
BASES = "ACGTUNRYSWKMBDHV"
COMPLEMENTS = "TGCAANYRSWMKVHDB"

# Struct format codes -> (Spark type, smallest, greatest); None where the type has no bounds to clamp to.
FORMATS: dict[str, tuple[T.DataType, int | None, int | None]] = {
    "B": (T.ShortType(), 0, 2**8 - 1), "H": (T.IntegerType(), 0, 2**16 - 1), "I": (T.LongType(), 0, 2**32 - 1), "L": (T.LongType(), 0, 2**32 - 1),
    "Q": (T.LongType(), 0, 2**63 - 1), "b": (T.ByteType(), -(2**7), 2**7 - 1), "h": (T.ShortType(), -(2**15), 2**15 - 1), "i": (T.IntegerType(), -(2**31), 2**31 - 1),
    "l": (T.IntegerType(), -(2**31), 2**31 - 1), "q": (T.LongType(), -(2**63), 2**63 - 1), "f": (T.FloatType(), None, None), "d": (T.DoubleType(), None, None),
}


def spark_type(code: str) -> T.DataType:
    """Spark type of a struct code; `c` and `Ns` are strings."""
    if code == "c" or code.endswith("s"):
        return T.StringType()
    if code not in FORMATS:
        raise ValueError(f"unknown format code {code!r}")
    return FORMATS[code][0]


def saturate(x: Column, code: str) -> Column:
    """Cast to a format code: numbers are clamped to its range, text is cut to its width, nulls stay."""
    if code == "c":
        return F.substring(x.cast("string"), 1, 1)
    if code.endswith("s"):
        return F.substring(x.cast("string"), 1, int(code[:-1] or 1))
    kind, low, high = FORMATS[code]
    if low is None:
        return x.cast(kind)
    wide = x.cast("decimal(38,0)")
    return F.when(x.isNull(), None).otherwise(F.greatest(F.least(wide, F.lit(high).cast("decimal(38,0)")), F.lit(low).cast("decimal(38,0)"))).cast(kind)


def revcomp(seq: Column) -> Column:
    """Reverse complement of upper- or lower-case IUPAC text."""
    return F.translate(F.reverse(seq), BASES + BASES.lower(), COMPLEMENTS + COMPLEMENTS.lower())


def context3(seq: Column, pos: Column, strand: Column) -> Column:
    """Three letters from a cytosine on its own strand, upper-case, padded with N; without letters CNN."""
    plus = F.rpad(F.upper(F.substring(seq, pos, F.lit(3))), 3, "N")
    minus = F.when(pos < 3, F.lit("CNN")).otherwise(F.upper(revcomp(F.substring(seq, pos - 2, F.lit(3)))))
    return F.when(strand == "+", plus).otherwise(minus)


def is_cg(context: Column) -> Column:
    return context.startswith("CG")


def context_predicate(pattern: str, context: Column, strand: Column) -> Column:
    """CGN, CHN (the rest), and either with a strand sign in front."""
    if pattern.lstrip("+-") not in ("CGN", "CHN") or len(pattern) > 4:
        raise ValueError(f"unknown pattern {pattern!r}")
    out = is_cg(context) if pattern.endswith("CGN") else ~is_cg(context)
    return out & (strand == pattern[0]) if pattern[0] in "+-" else out


def safe_ratio(mc: Column, cov: Column) -> Column:
    """mc / cov, 0 where cov is 0."""
    return F.when(cov == 0, F.lit(0.0)).otherwise(F.try_divide(mc.cast("double"), cov.cast("double")))


@F.pandas_udf(T.DoubleType())
def sig3(x: pd.Series) -> pd.Series:
    """Three significant digits, rounded as C's %.3g does; every different value of a batch is formatted once."""
    codes, values = pd.factorize(x)
    return pd.Series(np.append([float("%.3g" % v) for v in values], np.nan)[codes])


#: Numbers up to which logarithms of factorials are looked up; beyond, Stirling's series is exact to the last digits.
FACTORIALS = 1 << 16
#: Weights up to this factor of the seen one count as no likelier, as a logarithm.
TIE = math.log(1 + 1e-7)
#: Cells of hypergeometric tables that are summed at once.
CELLS = 1 << 21


@lru_cache(maxsize=1)
def _log_factorials() -> np.ndarray:
    """The C library's lgamma, which SQL engines call too; Python's own differs from it in the last digits."""
    try:
        lgamma = ctypes.CDLL(ctypes.util.find_library("m") or "libm.so.6").lgamma
        lgamma.restype, lgamma.argtypes = ctypes.c_double, [ctypes.c_double]
    except (OSError, AttributeError):
        lgamma = math.lgamma
    return np.array([lgamma(n + 1.0) for n in range(FACTORIALS)])


def log_factorial(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, np.int64)
    small = _log_factorials()[np.minimum(n, FACTORIALS - 1)]
    if not (n >= FACTORIALS).any():
        return small
    x = np.maximum(n, 1).astype(np.float64)
    series = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n >= FACTORIALS, series, small)


def _log_p(k, row1, row2, col1):
    """Log of the hypergeometric weight of k, without the part that all k share."""
    return -log_factorial(k) - log_factorial(row1 - k) - log_factorial(col1 - k) - log_factorial(row2 - col1 + k)


def _reach(low: int, high: int, row1: int, row2: int, col1: int) -> tuple[int, int]:
    """The part of a wide support outside which weights are 0 in double precision; the weights have one peak."""
    at = lambda k: float(_log_p(np.int64(k), row1, row2, col1))
    mode = min(max((row1 + 1) * (col1 + 1) // (row1 + row2 + 2), low), high)
    least = at(mode) - 746
    ends = []
    for end in (low, high):
        inner, outer = mode, end
        while abs(outer - inner) > 1:
            mid = (inner + outer) // 2
            inner, outer = (mid, outer) if at(mid) >= least else (inner, mid)
        ends.append(outer)
    return ends[0], ends[1]


def fisher_exact(a, b, c, d) -> np.ndarray:
    """Two-sided p of 2x2 tables: the sum of all tables with the same margins that are no likelier than the one seen.

    Different tables are computed once, many at a time; memory is bounded by CELLS and the widest reach of a table.
    Tables of fewer than FACTORIALS in all are summed step by step as the formula reads, k upwards, so that the last
    digits are those of the same formula in SQL; in larger ones such logarithms lose digits, and weights are taken
    relative to their greatest.
    """
    tables = np.stack([np.asarray(v, np.int64) for v in (a, b, c, d)], 1)
    if not len(tables):
        return np.empty(0)
    tables, back = np.unique(tables, axis=0, return_inverse=True)
    seen, row1, row2, col1 = tables[:, 0], tables[:, 0] + tables[:, 1], tables[:, 2] + tables[:, 3], tables[:, 0] + tables[:, 2]
    low, high = np.maximum(0, col1 - row2), np.minimum(row1, col1)
    small = row1 + row2 < FACTORIALS
    for i in np.flatnonzero(high - low > FACTORIALS):
        low[i], high[i] = _reach(*(int(v[i]) for v in (low, high, row1, row2, col1)))
    out = np.empty(len(tables))
    for which, weigh in ((small, _formula), (~small, _relative)):
        own = np.flatnonzero(which)
        size = np.cumsum(high[own] - low[own] + 1)
        at = 0
        while at < len(own):
            n = max(1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CELLS, "right")) - at)
            t = own[at : at + n]
            out[t] = np.minimum(1.0, weigh(low[t], high[t], seen[t], row1[t], row2[t], col1[t]))
            at += n
    return out[back.ravel()]


def _cells(low, high):
    """The numbers of each support one after the other: where each starts, whose each is, and the number itself."""
    size = high - low + 1
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    of = np.repeat(np.arange(len(size)), size)
    return starts, of, np.arange(len(of)) - starts[of] + low[of]


def _formula(low, high, seen, row1, row2, col1) -> np.ndarray:
    _, of, k = _cells(low, high)
    lf, col2 = log_factorial, row1 + row2 - col1
    margins = lf(row1) + lf(row2) + lf(col1) + lf(col2) - lf(row1 + row2)
    logp = lambda k, m, r1, r2, c1: m - lf(k) - lf(r1 - k) - lf(c1 - k) - lf(r2 - c1 + k)
    p = logp(k, margins[of], row1[of], row2[of], col1[of])
    counted = np.flatnonzero(p <= (logp(seen, margins, row1, row2, col1) + TIE)[of])
    # the C library's exponentials, summed in order: NumPy's own may differ from both in the last digit
    weights = np.fromiter(map(math.exp, p[counted].tolist()), float, len(counted))
    return np.bincount(of[counted], weights, len(seen))


def _relative(low, high, seen, row1, row2, col1) -> np.ndarray:
    starts, of, k = _cells(low, high)
    logp = _log_p(k, row1[of], row2[of], col1[of])
    top = np.maximum.reduceat(logp, starts)
    p = np.exp(logp - top[of])
    mine = np.exp(_log_p(seen, row1, row2, col1) - top)
    counted = np.add.reduceat(np.where(p <= mine[of] * (1 + 1e-7), p, 0.0), starts)
    return counted / np.add.reduceat(p, starts)


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(fisher_exact(a, b, c, d))


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals, halves away from 0, as SQL engines round a double: the product is rounded, not the decimals that are printed."""
    y = F.abs(x) * F.lit(10.0**digits)
    whole = F.floor(y).cast("double")
    near = (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)
    return F.when(y < 2.0**53, F.when(x < 0, -near).otherwise(near)).otherwise(x)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """a*d / (b*c); infinite where only the denominator is 0, null for 0/0."""
    top, bottom = (a * d).cast("double"), (b * c).cast("double")
    return F.when(bottom != 0, F.try_divide(top, bottom)).when(top != 0, F.lit(float("inf")))


def make_offset(block: Column, within: Column) -> Column:
    """48-bit block offset and 16-bit offset inside it, in one long."""
    return F.shiftleft(block, 16).bitwiseOR(within.bitwiseAND(F.lit(0xFFFF)))


def split_offset(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, 16), packed.bitwiseAND(F.lit(0xFFFF))


def sample_name(path: Column, ext: str = "") -> Column:
    """File name without folder and extension (or without its last suffix)."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    cut = ext.replace(".", "\\.") + "$" if ext else "\\.[^.]*$"
    return F.regexp_replace(base, cut, "")


def nearest_ten(x: float) -> int:
    """A third of x, to the nearest ten."""
    return int(round(x / 3, -1))


def nearest_tens(x: Column) -> Column:
    """nearest_ten() of a column."""
    return F.bround(x.cast("double") / 3, -1).cast("long")


def register(spark: SparkSession) -> None:
    """Make the functions usable from SQL."""
    spark.udf.register("sig3", sig3)
    spark.udf.register("fisher_p", fisher_p)
    for name, args, body in (
        ("revcomp", "s STRING", f"translate(reverse(s), '{BASES + BASES.lower()}', '{COMPLEMENTS + COMPLEMENTS.lower()}')"),
        ("safe_ratio", "mc DOUBLE, cov DOUBLE", "CASE WHEN cov = 0 THEN 0D ELSE try_divide(mc, cov) END"),
        ("odds_ratio", "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE", "CASE WHEN b * c <> 0 THEN try_divide(a * d, b * c) WHEN a * d <> 0 THEN CAST('Infinity' AS DOUBLE) END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {'STRING' if name == 'revcomp' else 'DOUBLE'} RETURN {body}")
