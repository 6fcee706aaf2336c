"""Cutting lineage where a result is read several times, and scratch folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`.

    A local session that names none, as in tests, gets a temporary folder of its own; on a cluster
    such a folder would be another one on each machine, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pluvia-"))
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write the rows to the shared folder once, by column, and read them from there."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A `materialise` for the body, at whose end all that it wrote is deleted."""
    paths = []

    def write(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_folder(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield write
    finally:
        for path in paths:
            remove(spark, path)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job in the body go when it ends, not when the driver happens to collect its garbage.

    For bodies of many jobs that write what they make: the files of all of them are several times the input.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def dealt(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows in equal shares, one for each core unless ``tasks`` says otherwise.

    For rows that are few bytes but much work each: tasks sized by bytes would leave cores without any.
    """
    return df.repartition(tasks or df.sparkSession.sparkContext.defaultParallelism)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
