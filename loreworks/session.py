"""Session construction and lineage control shared by every job."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loreworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    UTC keeps epoch arithmetic stable, AQE re-plans joins and splits skewed partitions at run
    time, and the RocksDB provider is what ``transformWithState`` needs.  Cluster sizing
    (executors, shuffle partitions) is left to the submitter; values given here win.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may name none (tests, a laptop); it gets a temporary one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spark-points-", dir="/tmp")
        configured = _OWN_DIRS[app]
    return configured.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores when a scan has fewer splits than there are cores.

    For CPU-bound work on a table of few splits, which would keep it on few cores.  A table
    with enough splits, as any large one has, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def save_point(df: DataFrame, dealt: bool = False) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    Used where an iterative job must cut its lineage or a result is used several times.  A
    written table survives lost executors, and its real size lets the planner choose the
    right join on the next round.  ``dealt`` spreads a small table for heavy work to come.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "loreworks", uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    return spread(saved) if dealt else saved


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Batch functions are loaded by name on the workers, which may not have the repository.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-pkg-", dir="/tmp"), "loreworks")
    shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(target + ".zip")
    _SHIPPED.add(app)
