"""Tables that are built once: Parquet folders named by what they were built from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def name_of(name: str, params: dict) -> str:
    """A folder name that depends on the parameters, whatever their order."""
    return f"{name}-{hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]}"


def cached(spark: SparkSession, folder: str, name: str, params: dict, build: Callable[[], DataFrame], sort_by: str | None = None) -> DataFrame:
    """The table of that name and parameters, built and written if it isn't there.

    sort_by: rows are written in ranges of that column, so that a lookup reads
    few row groups. A folder without the mark of a finished write is written anew.
    """
    path = f"{folder.rstrip('/')}/{name_of(name, params)}"
    try:
        spark.read.text(f"{path}/_SUCCESS").limit(0).count()
        return spark.read.parquet(path)
    except AnalysisException as x:
        if "PATH_NOT_FOUND" not in str(x):
            raise
    made = build()
    if sort_by:
        made = made.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
    made.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
