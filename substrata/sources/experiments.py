"""A store of experiment records: a Parquet folder that runs append to."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from substrata.operators.runs import SCHEMA, latest


def put(spark: SparkSession, path: str, tbl: str, key: str, value: dict) -> None:
    row = (tbl, key, json.dumps(value, sort_keys=True), time.time_ns())
    spark.createDataFrame([row], SCHEMA).write.mode("append").parquet(path)


def scan(spark: SparkSession, path: str, tbl: str | None = None, pattern: str | None = None) -> DataFrame:
    """The last value of each key, of one table and of keys that match a pattern with * and ?."""
    rows = latest(spark.read.schema(SCHEMA).parquet(path))
    if tbl is not None:
        rows = rows.where(F.col("tbl") == tbl)
    if pattern is not None:
        like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
        rows = rows.where(F.col("exp_key").like(like))
    return rows
