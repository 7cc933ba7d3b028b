"""Readers and writers of text and Parquet tables."""

from __future__ import annotations

import itertools
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import saturate
from ..model import schema_from_formats
from ..operators.select import where_dims
from ..storage import new_folder


def delimited(spark: SparkSession, path: str, names: list[str], formats: dict[str, str], use: list[str] | None = None, dims: list[str] = (), sep: str = "\t", header: bool = False, skip: int = 0) -> DataFrame:
    """Columns of delimited text, plain or gzip: chosen by name, saturated to their formats, dimensions as text in front.

    A gzip file is one task to read; its rows are dealt out right after, by their number in the file: dealt in turn,
    Spark would sort them all in that task first. skip: leading lines that aren't data.
    """
    if skip:
        rows = _without_first_lines(spark, path, skip + int(header))
        raw = rows.select(F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": sep}).alias("r")).select("r.*")
    else:
        raw = spark.read.csv(path, sep=sep, header=header, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), enforceSchema=True)
    if ".gz" in path:
        raw = raw.withColumn("_row", F.monotonically_increasing_id()).repartition(spark.sparkContext.defaultParallelism, "_row").drop("_row")
    return _typed(raw, [n for n in names if n not in dims] if use is None else use, formats, dims)


def _typed(raw: DataFrame, use: list[str], formats: dict[str, str], dims: list[str]) -> DataFrame:
    number = lambda n: F.expr(f"try_cast(`{n}` AS {'double' if formats[n] in 'fd' else 'decimal(38,0)'})")
    value = lambda n: F.col(n) if formats[n] == "c" or formats[n].endswith("s") else number(n)
    return raw.select(*dims, *(saturate(value(n), formats[n]).alias(n) for n in use))


def _without_first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Lines of all files but the first n of each. Only the first part of a file is searched for them; files stay split."""
    at = F.col("_metadata.file_block_start")
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), at.alias("_s"), F.monotonically_increasing_id().alias("_i"))
    place = F.row_number().over(Window.partitionBy("_f").orderBy("_i"))
    lead = rows.where("_s = 0").select("_f", "_i").withColumn("_k", place).where(F.col("_k") <= n).select("_i")
    return rows.join(lead, "_i", "left_anti").select("value")


def lines(spark: SparkSession, stream=None, rows: int = 100_000) -> DataFrame:
    """Lines of an open text stream (by default standard input), as they come, in order: (line number, line).

    The stream is written to the shared folder in parts of `rows` lines, so the driver holds one part at a time.
    """
    stream = sys.stdin if stream is None else stream
    folder, n = new_folder(spark, "streams"), 0
    schema = "line_number long, line string"
    while part := [x.rstrip("\n") for x in itertools.islice(stream, rows)]:
        spark.createDataFrame([(n + k, x) for k, x in enumerate(part, 1)], schema).write.mode("append").parquet(folder)
        n += len(part)
    return spark.read.schema(schema).parquet(folder) if n else spark.createDataFrame([], schema)


def from_stream(spark: SparkSession, names: list[str], formats: dict[str, str], stream=None, dims: list[str] = (), sep: str = "\t") -> DataFrame:
    """delimited(), for text that comes over a stream."""
    raw = lines(spark, stream).select(F.from_csv("line", ", ".join(f"`{n}` string" for n in names), {"sep": sep}).alias("r")).select("r.*")
    return _typed(raw, [n for n in names if n not in dims], formats, dims)


def to_stream(df: DataFrame, stream=None, header: bool = True, sep: str = "\t") -> int:
    """Rows as delimited text to an open stream (by default standard output), a partition at a time; the number of rows."""
    stream, n = sys.stdout if stream is None else stream, 0
    if header:
        stream.write(sep.join(df.columns) + "\n")
    for row in df.toLocalIterator():
        stream.write(sep.join("" if x is None else str(x) for x in row) + "\n")
        n += 1
    return n


def to_frame(df: DataFrame, dims: dict[str, str]):
    """One chunk - the rows of a dimension value - as a pandas frame, by row id."""
    return where_dims(df, dims).orderBy("id").toPandas()


def batches(df: DataFrame, size: int, order: str = "id") -> DataFrame:
    """Adds `batch`: number of the batch of `size` rows, by dense row ids, that a row belongs to."""
    return df.withColumn("batch", F.floor((F.col(order) - 1) / size))


def local_batches(df: DataFrame, dims: dict[str, str], size: int):
    """pandas frames of `size` rows of one chunk in the order of row ids; the driver holds one at a time."""
    rows = where_dims(df, dims).orderBy("id").toLocalIterator()
    while part := list(itertools.islice(rows, size)):
        yield pd.DataFrame(part, columns=df.columns)


def frame(spark: SparkSession, rows, formats: list[str], columns: list[str], dims: list[str]) -> DataFrame:
    """Rows in memory (pandas, lists, tuples) with the same casts as text."""
    schema = schema_from_formats(formats, columns, dims)
    names = [f.name for f in schema]
    pdf = rows if isinstance(rows, pd.DataFrame) else pd.DataFrame(list(rows), columns=names)
    text = spark.createDataFrame(pdf[names].astype(str), T.StructType([T.StructField(n, T.StringType()) for n in names]))
    kinds = dict(zip(columns, formats, strict=True))
    cast = lambda n: F.col(n) if kinds[n] == "c" or kinds[n].endswith("s") else F.col(n).cast("double" if kinds[n] in "fd" else "decimal(38,0)")
    return text.select(*dims, *(saturate(cast(n), kinds[n]).alias(n) for n in columns))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq): one row a record; line ends inside a sequence are taken out."""
    raw = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    return raw.select(F.regexp_extract("value", "^(\\S+)", 1).alias("chrom"), F.regexp_replace(F.regexp_replace("value", "^[^\\n]*\\n?", ""), "\\s", "").alias("seq"))


def order_file(spark: SparkSession, path: str, dim: str = "chrom") -> DataFrame:
    """(dim, ord): first column of a small headerless file, in its order. Read as one text, so that lines keep it."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ord", "l")).where("l <> ''")
    return lines.select(F.split("l", "\t")[0].alias(dim), "ord")


def contigs(spark: SparkSession, path: str, names: list[str], formats: dict[str, str], order: DataFrame | None = None, dim: str = "chrom", **more) -> DataFrame:
    """Delimited text restricted to, and numbered by, an order table."""
    rows = delimited(spark, path, names, formats, dims=[dim], **more)
    return rows if order is None else rows.join(F.broadcast(order), dim)


def class_table(spark: SparkSession, path: str, names: tuple[str, str] = ("sample", "cell_class")) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=f"{names[0]} string, {names[1]} string")


def region_bed(spark: SparkSession, path: str, named: bool = True) -> DataFrame:
    """chrom, start, stop and, if there is one, the name."""
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, stop long" + ", name string" * named)


def matrix(spark: SparkSession, path: str, keys: dict[str, str], samples: list[str] | None = None) -> DataFrame:
    """A matrix with a header row; all but the keys are doubles, empty fields null."""
    head = spark.read.csv(path, sep="\t", header=True)
    own = samples or [c for c in head.columns if c not in keys]
    return head.select(*(F.col(f"`{k}`").cast(t).alias(k) for k, t in keys.items()), *(F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in own))


def write_keyed(df: DataFrame, path: str, dims: list[str], mode: str = "error", order: str = "id") -> None:
    """Parquet partitioned by the dimensions and sorted by row id. mode: error, overwrite, append, or ignore (leave what is there)."""
    # a part of a dimension value is a task, cut by row id; a long one is many files, each of sorted ids
    df.repartitionByRange(*dims, order).sortWithinPartitions(*dims, order).write.mode(mode).partitionBy(*dims).parquet(path)


def write_text(df: DataFrame, path: str, header: bool = True, compression: str = "none", single: bool = False) -> None:
    """Tab-separated text; single: in one file, its rows in no set order, by a task that writes and does nothing else."""
    (df.repartition(1) if single else df).write.csv(path, sep="\t", header=header, compression=compression, quote="", escapeQuotes=False)


def write_matrix(df: DataFrame, path: str, order: list[str]) -> None:
    """A matrix as sorted, compressed text: one range of the order a file, so that the files in their order are sorted too."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.csv(path, sep="\t", header=True, compression="gzip")
