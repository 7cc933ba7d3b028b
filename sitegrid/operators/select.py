"""Projection and selection: views, dimension filters, point, interval and offset scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import context_predicate


def view(df: DataFrame, columns: list[str], dims: list[str] = (), show_dim: list[int] = ()) -> DataFrame:
    """Data columns behind the dimensions chosen by position."""
    return df.select(*(dims[i] for i in show_dim), *columns)


def column_slice(df: DataFrame, columns: list[str], start: int = 0, end: int | None = None) -> DataFrame:
    return df.select(*columns[start:end])


def where_dims(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Rows whose dimensions have all these values; prunes partitions where the table has them."""
    return df.where(reduce(Column.__and__, (F.col(k) == v for k, v in values.items()), F.lit(True)))


def in_order(df: DataFrame, dim: str, values: list[str], by: list[str] = ("id",)) -> DataFrame:
    """Rows of the listed values, in the list's order and then by `by`; values that don't occur are skipped."""
    place = F.array_position(F.array(*map(F.lit, values)), F.col(dim))
    return df.where(F.col(dim).isin(list(values))).orderBy(place, *by)


def by_order_table(df: DataFrame, dim: str, order: DataFrame, by: list[str] = ("id",)) -> DataFrame:
    """Like in_order, with the list as a table (dim, ord), which goes to every task."""
    return df.join(F.broadcast(order), dim).orderBy("ord", *by)


def by_context(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(context_predicate(pattern, F.col("context"), F.col("strand")))


def _numeric(df: DataFrame, *cols: str) -> None:
    for c in cols:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise TypeError(f"{c} isn't numeric: query a reference table's position instead")


def point_range(df: DataFrame, col: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """start <= col <= end; an open side is left out."""
    _numeric(df, col)
    if start is not None:
        df = df.where(F.col(col) >= start)
    return df if end is None else df.where(F.col(col) <= end)


def contained(df: DataFrame, begin: str, finish: str, start: int, end: int) -> DataFrame:
    """Intervals that lie inside [start, end]."""
    _numeric(df, begin, finish)
    return df.where((F.col(begin) >= start) & (F.col(finish) <= end))


def from_row(df: DataFrame, n: int, dims: dict[str, str] | None = None) -> DataFrame:
    """All rows from row n (1-based) on."""
    return where_dims(df, dims or {}).where(F.col("id") >= n)


def mask_unless_below(df: DataFrame, p: str = "pval", odds: str = "odd_ratio", limit: float = 1.0) -> DataFrame:
    """p becomes 1 where the odds ratio is at least `limit`, or isn't a number."""
    x = F.col(odds).try_cast("double") if hasattr(F.col(odds), "try_cast") else F.expr(f"try_cast({odds} AS double)")
    usable = x.isNotNull() & ~F.isnan(x) & (x < limit)
    return df.withColumn(p, F.when(usable, F.col(p)).otherwise(F.lit(1.0)))
