"""Session settings, and the shared folder for cutting lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "sievegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, AQE (skew joins included) and Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give Python workers this package, once per application.

    The archive is built on the driver and fetched from it by every executor,
    so nothing has to be installed on the machines.
    """
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="sievegrid-"), "sievegrid.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, names in sorted(os.walk(package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.relpath(full, os.path.dirname(package)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(application)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` wins. Where it is unset a local master gets a
    fresh temporary folder; a real cluster is refused, because a machine-local
    folder would be lost with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current.rsplit("/", 1)[0]
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="sievegrid-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor costs no recomputation
    and every reader sees the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles and checkpoints that nothing refers to any more.

    They stay on disk until the driver happens to collect its garbage, so a query of many steps
    would hold the files of all of them. What is still referred to isn't touched.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rebalance(df: DataFrame, *keys: str) -> DataFrame:
    """Even out rows before CPU-heavy work.

    A shuffle of few bytes is merged into few tasks; an explicit partition count
    keeps all cores busy when every row is about to expand or enter Python.
    """
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wanted, *keys)


def unnest(df: DataFrame, array: Column, name: str, *keep: str | Column) -> DataFrame:
    """One row per element of a computed array, none for an empty one.

    ``explode`` makes the optimizer test the array's size as early as it can,
    which computes a costly array a second time below the last shuffle. The
    outer form infers no such test; empty arrays drop out afterwards.
    """
    rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())
