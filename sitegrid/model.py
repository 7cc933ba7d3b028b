"""The data model: tables keyed by string dimensions, with an explicit 1-based row id inside each key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import saturate, spark_type
from .storage import cut


def schema_from_formats(formats: list[str] | str, columns: list[str] | str, dims: list[str] | str) -> T.StructType:
    """StructType of a table: string dimensions first, then a column per format code."""
    formats, columns, dims = (v.split(",") if isinstance(v, str) else list(v) for v in (formats, columns, dims))
    if len(formats) != len(columns):
        raise ValueError("one format code a column is needed")
    return T.StructType([T.StructField(d, T.StringType()) for d in dims] + [T.StructField(c, spark_type(f)) for f, c in zip(formats, columns, strict=True)])


def typed(df: DataFrame, formats: list[str], columns: list[str], keep: list[str]) -> DataFrame:
    """Saturating casts of the columns; `keep` (dimensions, id) is carried along."""
    return df.select(*keep, *(saturate(F.col(c), f).alias(c) for f, c in zip(formats, columns, strict=True)))


def ordinals(df: DataFrame, dims: list[str], by: str, name: str, width: int = 65_536) -> DataFrame:
    """Adds the 1-based place of every row inside its dimension value, in the order of a whole-numbered column.

    Rows are numbered inside blocks of `width` values of the column and moved by the counts of the blocks before, so a
    long dimension value is many tasks; what is ordered in one task is one row a block.
    """
    key = F.struct(*dims, F.floor(F.col(by) / width).alias("_b"))  # one column: nulls in it equal nulls, and all steps share its partitioning
    counts = df.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*(F.col("_key")[d] for d in dims)).orderBy(F.col("_key")["_b"])
    before = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("_key", F.coalesce(before, F.lit(0)).alias("_shift"))
    rows = df.withColumn("_key", key).withColumn("_at", F.row_number().over(Window.partitionBy("_key").orderBy(by)))
    return rows.join(shifts, "_key").select(*(c for c in df.columns if c != name), (F.col("_at") + F.col("_shift")).alias(name))


def assign_ids(df: DataFrame, dims: list[str], order: list[str], distributed: bool = False) -> DataFrame:
    """Adds `id`: 1, 2, ... inside each dimension value, in the given order of any columns.

    The plain form is a window, one task per dimension value. The distributed form sorts by range, counts rows per
    (partition, dimension value) and adds the offsets, so that a value with many rows spreads over many tasks; the
    counts are as many as partitions and values that meet, and the sorted rows are cut at the shared folder. Where one
    whole-numbered column gives the order, ordinals() does it without writing.
    """
    if not distributed:
        return df.withColumn("id", F.row_number().over(Window.partitionBy(*dims).orderBy(*order)).cast("long"))
    local = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*dims, *order).sortWithinPartitions(*dims, *order)
    placed = cut(placed.withColumn("_at", local.bitwiseAND(F.lit((1 << 33) - 1))).withColumn("_part", F.shiftright(local, 33)))
    runs = placed.groupBy("_part", *dims).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*dims).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_part").alias("_p"), *(F.col(d).alias(f"_d{k}") for k, d in enumerate(dims)), (before - F.col("_first") + 1).alias("_shift"))
    on = reduce(and_, (F.col(d).eqNullSafe(F.col(f"_d{k}")) for k, d in enumerate(dims)), F.col("_part") == F.col("_p"))
    return placed.join(runs, on).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("id"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; an empty result means that they identify rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def chunk_directory(df: DataFrame, dims: list[str]) -> DataFrame:
    """Rows per dimension value."""
    return df.groupBy(*dims).agg(F.count("*").alias("nrows"))
