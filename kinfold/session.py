"""Session defaults that suit both a laptop and a cluster."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Arrow batches to and from Python workers; documents may be long, and a worker holds a batch several times over.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
_shipped: set[str] = set()


def get_session(app: str = "kinfold", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the application's Python workers, once per application.

    The driver hands the archive to Spark, whose file server sends it to every
    executor; nothing is expected to be installed there.  Arrow batches get a
    bound of ``BATCH_BYTES`` unless the session has a lower one.
    """
    name, most = BATCH_BYTES
    if spark.conf.get(name).removesuffix("b") in ("-1", str(64 << 20)):
        spark.conf.set(name, str(most))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("kinfold", os.path.relpath(path, package)))
    target = os.path.join(tempfile.mkdtemp(prefix="kinfold-"), "kinfold.zip")
    with open(target, "wb") as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; ``sf_dir`` may be any path that Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
