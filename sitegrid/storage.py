"""The cluster's shared folder: where lineage is cut and tables that are read more than once are kept."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, else the one that the context was given.

    Only a session on one machine (tests) may do without either; a cluster without a shared folder is refused, because
    its machines would write where the others can't read.
    """
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if path is None:
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set: a cluster needs a folder that all its machines share")
        path = "file:///tmp/checkpoints"
    if not given.isDefined():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new name in the application's own folder, which goes when the interpreter ends in good order."""
    context = spark.sparkContext
    own = f"{shared_folder(spark)}/{kind}/{context.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_forget, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


_OWN: set[str] = set()


def _forget(spark: SparkSession, own: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, own)


def cut(df: DataFrame) -> DataFrame:
    """The rows written as a checkpoint to the shared folder, lineage cut there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Spark's switch for removing a query's shuffle files when the query ends, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files, so a long job's disk holds those of one query at a time."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Kept:
    """Tables in the shared folder for the time of a `with` block; what is left behind must not read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, new_folder(spark, "tables")
        self.n = 0

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)

    def __call__(self, df: DataFrame) -> DataFrame:
        """Write the rows as a compressed columnar table and read them from there."""
        self.n += 1
        return _written(df, f"{self.root}/{self.n}")


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), but as a compressed columnar table that stays until the application ends."""
    return _written(df, new_folder(df.sparkSession, "tables"))


def _written(df: DataFrame, path: str) -> DataFrame:
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
