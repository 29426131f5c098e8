"""Cutting lineage with tables in the folder that driver and executors share.

A stage that is read more than once is written as Parquet below
``spark.checkpoint.dir`` and read again, so a lost executor costs one stage and
not the whole job.  Where the setting is absent (unit tests, a laptop) the
session's warehouse folder is used, which a cluster shares as well.

Tables made inside :func:`scratch` are deleted when it ends, but for those
that are kept; the rest stay until :func:`release`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, or its warehouse when unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kinfold"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/kinfold/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, label)
    if (made := _made.get()) is not None:
        made.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._kinfold_path = path
    return back


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def tidy(spark: SparkSession) -> None:
    """Ask the driver for a garbage collection, upon which Spark deletes the shuffle files of finished jobs."""
    spark.sparkContext._jvm.System.gc()


def tidy_executors(spark: SparkSession) -> None:
    """Ask every executor for a garbage collection, upon which it gives back what its heap has grown to and the native memory of dead buffers and classes.

    A task for each core, so that no executor is left out; in local mode the driver is the executor.
    """
    context = spark.sparkContext
    if context._jsc.sc().isLocal():
        return tidy(spark)
    cores = context.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def release(*tables: DataFrame) -> None:
    """Delete the files behind tables made by :func:`durable`."""
    for df in tables:
        delete(df.sparkSession, [df._kinfold_path])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables made inside, but for those given to the function it yields; these fall to the scope around."""
    made, kept = [], []
    outer = _made.get()
    token = _made.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._kinfold_path)
        return df

    try:
        yield keep
    finally:
        _made.reset(token)
        delete(spark, [p for p in made if p not in kept])
        if outer is not None:
            outer += kept


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Lists the tables made inside that no inner :func:`scratch` has deleted."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
