"""Tables and files that an operator makes on its way, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it.

    Only where spark.checkpoint.dir is unset and all runs on one machine, a
    temporary folder takes its place.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = context._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else None
    if not path and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="substrata-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute now and keep in the shared folder, so that no later step repeats the work."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Let the driver's JVM drop tables that nothing refers to any more: with them go the shuffle files of steps that are done, which else stay until its memory is full."""
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
