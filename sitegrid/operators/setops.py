"""Union of tables, with their origin as a dimension."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sample_name


def concat(frames: dict[str, DataFrame], order: list[str] | None = None, title: str | None = None, name: Callable[[str], str] | None = None) -> DataFrame:
    """All rows of the named frames, sorted by name or in the given order (unlisted ones are left out, unknown names raise).

    With `title` the name, or name(name), becomes a last dimension of that title.
    """
    names = sorted(frames) if order is None else list(order)
    if missing := [n for n in names if n not in frames]:
        raise KeyError(f"no table named {missing[0]!r}")
    tagged = [frames[n].withColumn(title, F.lit(name(n) if name else n)) if title else frames[n] for n in names]
    return reduce(DataFrame.unionByName, tagged)


def with_file_name(df: DataFrame, title: str = "filename", ext: str = "", folder: bool = False) -> DataFrame:
    """The source file's name without folder and extension as a last dimension; folder: that of the folder it lies in,
    for tables of several part files."""
    path = F.input_file_name()
    return df.withColumn(title, sample_name(F.regexp_replace(path, "/[^/]*$", "") if folder else path, ext))


def concat_dmrs(dmrs: dict[str, DataFrame], drop: tuple[str, ...] = ("min_p", "z_p", "z_sidak_p")) -> DataFrame:
    """DMR tables of all samples in one, with sname and without the listed columns."""
    return concat({s: d.drop(*drop) for s, d in dmrs.items()}, title="sname")
