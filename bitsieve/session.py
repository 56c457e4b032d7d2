"""Session helpers: a local session for tests, and the folder for checkpoints."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "bitsieve") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary one, which goes when the
    process ends; a cluster is refused. Checkpoints in a folder that was set go with
    their DataFrames if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = getattr(spark, "_bitsieve_folder", None)
        if where is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = spark._bitsieve_folder = tempfile.mkdtemp(prefix="bitsieve-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint: the rows are written to the shared folder and the plan starts there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, by Hadoop's file system API so that any store works."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more, instead of at some later collection."""
    for _ in range(4):  # what Python lets go of reaches the JVM a little later
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
