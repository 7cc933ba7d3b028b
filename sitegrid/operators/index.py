"""Subset indexes: row ids by context, row-id intervals by region, and their use."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ordinals
from .join import by_id_intervals, by_id_set, by_ids, positions_to_ids, zip_rows
from .select import by_context


def subset_index(df: DataFrame, dims: list[str], pattern: str | None = None, match: Callable[[DataFrame], DataFrame] | Column | None = None) -> DataFrame:
    """(dims, id) of the rows that a pattern or a predicate picks."""
    picked = by_context(df, pattern) if pattern else df.where(match) if isinstance(match, Column) else match(df)
    return picked.select(*dims, "id")


def region_index(ref: DataFrame, regions: DataFrame, dims: list[str], boundary: str = "overshoot", **cols) -> DataFrame:
    """(dims, region columns, id_start, id_end) of the regions that have rows."""
    return positions_to_ids(ref, regions, dims, boundary=boundary, **cols)


def renumber(df: DataFrame, dims: list[str]) -> DataFrame:
    """New ids 1, 2, ... in the order of the old ones."""
    return ordinals(df, dims, "id", "id").select(df.columns)


def extract(df: DataFrame, index: DataFrame, dims: list[str]) -> DataFrame:
    """The index's rows, numbered anew; the schema stays. Intervals are refused."""
    if "id_start" in index.columns:
        raise ValueError("extract takes an index of single rows")
    return renumber(by_id_set(df, index, dims), dims)


def subset(df: DataFrame, index: DataFrame, dims: list[str], ref: DataFrame | None = None) -> DataFrame:
    """Rows of either kind of index, with the reference's columns if one is given."""
    out = by_id_intervals(df, index, dims) if "id_start" in index.columns else by_ids(df, index, dims)
    return zip_rows(ref, out, dims) if ref is not None else out


# IUPAC codes of several letters, as they occur in context patterns.
AMBIGUOUS = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}


def cytosines(genome: DataFrame, name: str = "chrom", seq: str = "seq", chunk: int = 65_536, pattern: str = "C") -> DataFrame:
    """Every C of both strands whose context fits the pattern: name, pos (1-based), strand, context.

    `pattern` is C and up to two more IUPAC letters (CG, CHG, ...); N fits any letter. A sequence is first cut into
    chunks with two letters to either side, so that no task explodes a whole contig. Chunks are slices of bytes, which
    cost no walk from the sequence's start; a letter beyond ASCII counts as one N.
    """
    from ..functions import context3

    if not re.fullmatch("C[ACGTN" + "".join(AMBIGUOUS) + "]{0,2}", pattern):
        raise ValueError(f"unknown pattern {pattern!r}")
    plain = F.when(F.octet_length(seq) == F.length(seq), F.col(seq)).otherwise(F.regexp_replace(seq, "[^\\x00-\\x7F]", "N")).cast("binary")
    raw = genome.where(F.length(seq) > 0).select(name, plain.alias("_q"))
    size = F.length("_q")
    parts = raw.withColumn("_from", F.explode(F.sequence(F.lit(1), size, F.lit(chunk))))
    lead = F.least(F.col("_from") - 1, F.lit(2))
    parts = parts.select(name, "_from", lead.alias("_lead"), F.substring(F.col("_q"), F.col("_from") - lead, F.lit(chunk + 2) + lead).cast("string").alias("_s"), F.least(F.lit(chunk), size - F.col("_from") + 1).alias("_n"))
    own = F.substring(F.col("_s"), F.col("_lead") + 1, F.col("_n"))
    letters = parts.select(name, "_from", "_lead", "_s", F.posexplode(F.split(F.upper(own), "")).alias("_i", "_c")).where("_c in ('C', 'G')")
    strand = F.when(F.col("_c") == "C", "+").otherwise("-")
    # a "-" context needs two letters before it; at a sequence's start the chunk has no lead, which gives CNN
    out = letters.select(name, (F.col("_from") + F.col("_i")).cast("long").alias("pos"), strand.alias("strand"), context3(F.col("_s"), F.col("_lead") + F.col("_i") + 1, strand).alias("context"))
    fits = "".join("." if c == "N" else f"[{AMBIGUOUS[c]}]" if c in AMBIGUOUS else c for c in pattern[1:])
    return out.where(F.col("context").rlike(f"^C{fits}")) if fits.strip(".") else out
