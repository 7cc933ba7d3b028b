"""Continuous ingest: micro-batches merged into a site table, whose sums are associative."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import cut


def running_sums(stream: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sum of each value by key over all that has come in; start it in complete or update mode."""
    return stream.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))


def merge_into(stream: DataFrame, path: str, keys: list[str], values: list[str], checkpoint: str) -> StreamingQuery:
    """Append every micro-batch's partial sums under its number; a batch that comes again replaces its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The table that merge_into has written, summed over its batches."""
    return df.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))


def runs(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds `run`: the number of the run of equal keys, in the given order (gaps and islands).

    Rows are sorted by range into blocks, cut at the shared folder, and runs are counted inside each block; a block
    whose first keys equal the last ones of the block before goes on with its run. What is ordered in one task is one
    row a block.
    """
    local, key = F.monotonically_increasing_id(), F.struct(*keys)
    placed = df.repartitionByRange(order).sortWithinPartitions(order)
    placed = cut(placed.withColumn("_at", local.bitwiseAND(F.lit((1 << 33) - 1))).withColumn("_part", F.shiftright(local, 33)))
    inside = Window.partitionBy("_part").orderBy("_at")
    new = F.when(key == F.lag(key).over(inside), 0).otherwise(1)
    counted = placed.withColumn("_new", new).withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = counted.groupBy("_part").agg(F.max("_run").alias("_n"), F.min_by(key, "_at").alias("_first"), F.max_by(key, "_at").alias("_last"))
    along = Window.orderBy("_part")
    blocks = blocks.withColumn("_goes_on", F.when(F.col("_first") == F.lag("_last").over(along), 1).otherwise(0))
    before = F.coalesce(F.sum(F.col("_n") - F.col("_goes_on")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = blocks.select("_part", (before - F.col("_goes_on")).alias("_shift"))
    return counted.join(shifts, "_part").select(*df.columns, (F.col("_run") + F.col("_shift")).cast("long").alias("run"))
