"""Joins by row id, position and interval.

Interval joins are equi-joins on (dimension, bin): intervals go to every bin that they touch, points to one, and the
range test is what remains. An inequality alone would compare all pairs of a dimension value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zip_rows(ref: DataFrame, data: DataFrame, dims: list[str]) -> DataFrame:
    """Rows with the same id side by side, as far as both go."""
    return ref.join(data, [*dims, "id"])


def range_by_reference(ref: DataFrame, data: DataFrame, dims: list[str], pos: str, values: dict[str, str], start: int, end: int) -> DataFrame:
    """Rows of `data` whose reference position lies in [start, end]."""
    from .select import point_range, where_dims

    return zip_rows(point_range(where_dims(ref, values), pos, start, end), where_dims(data, values), dims)


def align(ref: DataFrame, m: DataFrame, on: list[str], fill: dict[str, object]) -> DataFrame:
    """Every reference row with its measurement, or the fill values; measurements off the reference are dropped."""
    out = ref.join(m, on, "left")
    for c, v in fill.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


#: Bin widths of interval joins grow by this factor from level to level.
LEVEL = 16


def points_in_intervals(points: DataFrame, regions: DataFrame, dims: list[str], pos: str, start: str, end: str, width: int = 1024) -> DataFrame:
    """All (point, region) with start <= pos <= end; a point comes once for each region that holds it.

    An interval goes to the bins of one level, chosen by its length so that it touches at most LEVEL + 1 of them; a
    point is looked up once on every level that has intervals. So a long interval isn't copied to many small bins.
    """
    length = F.col(end) - F.col(start)
    level = F.greatest(F.ceil(F.log(float(LEVEL), F.greatest(length, F.lit(1)) / (width * LEVEL))), F.lit(0)).cast("int")
    bin_width = F.lit(width) * F.pow(F.lit(float(LEVEL)), F.col("_level")).cast("long")
    spread = regions.where(F.col(start) <= F.col(end)).withColumn("_level", level)
    spread = spread.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor(F.col(end) / bin_width))))
    used = spread.agg(F.collect_set("_level")).scalar()  # a few numbers
    binned = points.withColumn("_levels", used).withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_bin", F.floor(F.col(pos) / bin_width))
    return binned.join(spread, [*dims, "_level", "_bin"]).where(F.col(pos).between(F.col(start), F.col(end))).drop("_bin", "_level")


def by_ids(df: DataFrame, ids: DataFrame, dims: list[str]) -> DataFrame:
    """Rows of the listed ids; an id that is listed twice comes twice."""
    return ids.join(df, [*dims, "id"])


def by_id_set(df: DataFrame, ids: DataFrame, dims: list[str]) -> DataFrame:
    """Rows whose id is listed."""
    return df.join(ids.select(*dims, "id"), [*dims, "id"], "left_semi")


def by_id_intervals(df: DataFrame, index: DataFrame, dims: list[str], width: int = 1024) -> DataFrame:
    """Rows with id_start <= id <= id_end, for every interval of the index."""
    return points_in_intervals(df, index, dims, "id", "id_start", "id_end", width)


def positions_to_ids(ref: DataFrame, regions: DataFrame, dims: list[str], pos: str = "pos", start: str = "start", stop: str = "stop", boundary: str = "overshoot", width: int = 65_536) -> DataFrame:
    """id_start, id_end of every region.

    id_start is the first row at or after `start`. id_end is, with "overshoot", the first row at or after `stop` (else
    the last row); with "contained" the last row at or before `stop`. A region behind all rows is left out, and with
    "contained" one without rows as well.

    Forward and backward as-of joins: rows and boundaries are sorted together inside blocks of `width` positions, so a
    long dimension value is many tasks; where a block has no answer, the nearest filled block gives it.
    """
    if boundary not in ("overshoot", "contained"):
        raise ValueError(f"unknown boundary {boundary!r}")
    keys = [c for c in regions.columns if c not in dims]
    region = F.struct(*keys).alias("_r")
    block = lambda c: F.floor(F.col(c) / width).alias("_b")
    rows = ref.select(*dims, F.col(pos).cast("long").alias("_p"), block(pos), F.col("id").alias("_id"), F.lit(1).alias("_kind"))
    kinds = regions.groupBy(*dims, region).agg(F.count("*").alias("_n"))  # a region that is listed twice keeps both its rows
    ends = kinds.select(*dims, "_r", F.explode(F.array(F.struct(F.col(f"_r.{start}").cast("long").alias("_p"), F.lit(0).alias("_kind")), F.struct(F.col(f"_r.{stop}").cast("long").alias("_p"), F.lit(2).alias("_kind")))).alias("_e"))
    ends = ends.select(*dims, F.col("_e._p").alias("_p"), block("_e._p"), F.lit(None).cast("long").alias("_id"), F.col("_e._kind").alias("_kind"), "_r")
    both = rows.withColumn("_r", F.lit(None).cast(ends.schema["_r"].dataType)).unionByName(ends)
    # at one position a row is ahead of a boundary, and behind it too
    # what follows is what precedes in descending order: a frame that only grows costs one step a row
    at = Window.partitionBy(*dims, "_b")
    so_far = lambda order: at.orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_ahead", F.min("_id").over(so_far(F.desc("_p")))).withColumn("_behind", F.max("_id").over(so_far(F.asc("_p"))))
    along = Window.partitionBy(*dims)
    others = lambda order: along.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy(*dims, "_b").agg(F.min("_id").alias("_first"), F.max("_id").alias("_final"))
    blocks = blocks.withColumn("_next", F.min("_first").over(others(F.desc("_b")))).withColumn("_prev", F.max("_final").over(others(F.asc("_b"))))
    blocks = blocks.withColumn("_last", F.max("_final").over(along)).select(*dims, "_b", "_next", "_prev", "_last")
    seen = both.where("_r is not null").join(blocks, [*dims, "_b"]).withColumn("_ahead", F.coalesce("_ahead", "_next")).withColumn("_behind", F.coalesce("_behind", "_prev"))
    final = F.coalesce("_ahead", "_last") if boundary == "overshoot" else F.col("_behind")
    one = seen.groupBy(*dims, "_r").agg(F.max(F.when(F.col("_kind") == 0, F.col("_ahead"))).alias("id_start"), F.max(F.when(F.col("_kind") == 2, final)).alias("id_end"))
    one = one.where("id_start is not null and id_end is not null")
    if boundary == "contained":
        one = one.where("id_start <= id_end")
    many = one.join(kinds, [*dims, "_r"]).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return many.select(*dims, "_r.*", "id_start", "id_end")


def first_at_or_after(ref: DataFrame, points: DataFrame, dims: list[str], pos: str = "pos", **more) -> DataFrame:
    """Points with the id of the first reference row at or after each; points behind all rows are left out."""
    ends = points.withColumn("_stop", F.col(pos))
    return positions_to_ids(ref, ends, dims, start=pos, stop="_stop", **more).drop("_stop", "id_end").withColumnRenamed("id_start", "id")


def with_class(df: DataFrame, classes: DataFrame, key: str = "sample") -> DataFrame:
    """Rows of the classified samples with their class.

    The class table has a row a sample and goes to every task: dealt by sample, all rows of one would meet in a task.
    """
    return df.join(F.broadcast(classes), key)


def attributes(regions: DataFrame, dmr: DataFrame, keys: list[str]) -> DataFrame:
    """Regions with the attributes of the matching DMR, null without one."""
    return regions.join(dmr, keys, "left")
