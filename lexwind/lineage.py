"""Cutting lineage where a later step must see exactly the same rows, or where recomputing would be dear."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a local master gets a temporary one; a cluster gets an error, since its machines share no such folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute once, store in the shared checkpoint folder and forget the lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    out, made = df.checkpoint(eager=True), _made.get()
    if made is not None:
        made.append(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out


def by_shuffle(df: DataFrame) -> DataFrame:
    """One side of a join whose rows meet the other side's in a shuffle, never in a broadcast.

    For rows with samples, features or file contents: Spark takes an array or a file for a hundred bytes or so, and would send
    gigabytes of them through the driver.
    """
    return df.hint("merge")


def forget_later(path: str) -> None:
    """A folder that a step has written in the shared folder: deleted along with what cut() stored, where passing_cuts() is in use."""
    if (made := _made.get()) is not None:
        made.append(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark knows; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def rename_folder(spark: SparkSession, path: str, to: str) -> bool:
    """False, without a change, if there is something by the new name."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    return not fs.exists(new) and fs.rename(old, new)


@contextmanager
def passing_cuts(spark: SparkSession) -> Iterator[None]:
    """What cut() stores inside the block is deleted after it, so nothing lazy that reads it may leave the block."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            delete_folder(spark, path)
