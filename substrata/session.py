"""Session factory and the few settings the package relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("substrata")
    settings = DEFAULTS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cores), "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    os.environ.setdefault("PYSPARK_PYTHON", os.sys.executable)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by path on the driver's machine or a shared file system, else as a zip file sent along."""
    context, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(root):  # it came as a zip file
        return
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in paths:
        return
    context.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if not context.master.startswith("local") and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        folder = tempfile.mkdtemp()  # Spark serves the file from here as long as the driver lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/substrata", "zip", root, "substrata"))
