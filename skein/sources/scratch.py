"""Cutting lineage through the shared folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files are deleted at its end, not when the driver next collects garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of tables that are cut, by the innermost scope that is open.
_SCOPES: list[list[str]] = []


def scratch_folder(spark: SparkSession) -> str:
    """A folder under the one that spark.checkpoint.dir names. Only a local session that names none, as in tests, gets
    one here; a cluster without it is an error, as its machines would not see each other's files."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "skein-scratch"))
    return f"{context.getCheckpointDir()}/tables"


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read from there: later plans start at these files.

    A lost executor costs nothing, as the files are in the shared store. Unlike a checkpoint, what is read has the size
    of its files as its statistics: estimates do not multiply from turn to turn of a loop.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    with _shuffles_end(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables that have been cut, once nothing reads them any more. Other frames are left alone."""
    for df in frames:
        if path := getattr(df, "scratch_path", None):
            delete(df.sparkSession, path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Everything that is cut inside is deleted at the end: write what depends on it before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete what has been cut in this session, once its results have been written."""
    delete(spark, scratch_folder(spark))
