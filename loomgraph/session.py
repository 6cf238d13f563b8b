"""Session set-up and the one way in which lineage is cut."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "20g", partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomgraph")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used as it is.
    Only where nothing is set, and only on a local master, a temporary folder is taken.
    """
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomgraph-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files and checkpoints that nothing refers to any more; it does so when objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the workers this package, once a session, so that they need no installation of it."""
    sc = spark.sparkContext
    if not getattr(sc, "_loomgraph_shipped", False):
        root = Path(__file__).resolve().parent
        # In the shared folder if the cluster names one that is a path; the driver serves the file to the executors.
        shared = (sc.getConf().get("spark.checkpoint.dir", None) or "").removeprefix("file://")
        tmp = tempfile.mkdtemp(prefix="loomgraph-", dir=shared if shared.startswith("/") and Path(shared).is_dir() else None)
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{tmp}/loomgraph_pkg", "zip", root.parent, root.name))
        sc._loomgraph_shipped = True
    return spark
