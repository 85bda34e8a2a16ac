"""What plans need from the session: a shared folder for tables between steps, and bounded Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of an execution at its end, on all executors, where this is set when it begins.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, one is made on a local master, as in tests; on a cluster it is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quadrille-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Shelf:
    """Tables that a plan keeps in the shared folder: what is lost with an executor is read again from there.

    A table is written once, and the shuffle files that it took go at once, on all executors. drop() removes it when
    nothing reads it any more; what the result itself reads stays until the session's end.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
        self.number = 0
        #: By the DataFrame's identity, for which it has to be held.
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.number += 1
        path = f"{self.folder}/{self.number}"
        if self.number == 1:
            _SHELVES.append(self)
        with _without_shuffle_files(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = out, path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            removed(self.spark, self.held.pop(id(df))[1])


_SHELVES: list[Shelf] = []


@atexit.register
def _cleared() -> None:
    for shelf in _SHELVES:
        if shelf.held and shelf.spark.sparkContext._jsc is not None:
            removed(shelf.spark, shelf.folder)


def batches(spark: SparkSession, rows: int = 2048) -> None:
    """Has Arrow batches hold at most so many rows and 8 MB. Limits are only ever lowered, so that it does not matter which operator's plan is made first; workers cut batches further where they need it."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = int(spark.conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
