"""Approximate substring counts kept up to date over a stream of strings.

Counts add up over strings, so the block kernel turns each string into
(q, d, n) rows and a running sum per key is all the state there is: its size
is the number of queries times the thresholds, whatever has streamed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from substrata.plans.kernels import bit_parallel
from substrata.sources.work import remove, work_path


def streaming_histogram(stream: DataFrame, queries: list[str], delta: int, string_col: str = "s") -> DataFrame:
    """A streaming (q, d, n); write it in update or complete mode."""
    shared = stream.sparkSession.sparkContext.broadcast(sorted(set(queries)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            strings = [s for s in batch.column(0).to_pylist() if s is not None]
            found = bit_parallel(block, strings, np.ones(len(strings), np.int64), delta)
            at, d = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([block[k] for k in at], pa.string()), pa.array(d.astype(np.int32)), pa.array(found[at, d])], ["q", "d", "n"])

    return stream.select(string_col).mapInArrow(part, "q string, d int, n bigint").groupBy("q", "d").agg(F.sum("n").alias("n"))


def run_to_end(streaming: DataFrame, name: str) -> DataFrame:
    """Run over what is there now and return the result table, which executors write to the work folder batch by batch, the last one for good."""
    spark, path, batches = streaming.sparkSession, work_path(streaming.sparkSession, name), []

    def keep(result: DataFrame, number: int) -> None:
        result.write.parquet(f"{path}/{number}")
        batches.append(number)
        if len(batches) > 1:
            remove(spark, f"{path}/{batches[-2]}")

    query = streaming.writeStream.outputMode("complete").option("checkpointLocation", work_path(spark, f"{name}-state")).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(streaming.schema).parquet(f"{path}/{batches[-1]}") if batches else spark.createDataFrame([], streaming.schema)


def event_windows(stream: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per key and event-time window; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def open_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
