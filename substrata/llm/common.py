"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from substrata.sources.work import cut, remove, shared_dir, tidy, work_path

__all__ = ["cut", "draw", "id_text", "in_arrow", "keep_heap", "remove", "shared_dir", "small", "sql_draw", "table", "tidy", "union_all", "work_path"]

#: Draws use so many leading hexadecimal digits of an MD5 digest: 52 bits fit a double exactly.
DRAW_DIGITS = 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draw(*parts: Column | str) -> Column:
    """A number in (0, 1) that depends on the parts alone: every engine with MD5 gets the same one."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, DRAW_DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))


def id_text(column: str | Column) -> Column:
    """An id as text for hashing; null ids hash as one id of their own."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("null"))


def sql_draw(text: str) -> str:
    """draw() in DuckDB's SQL, for an expression that yields the joined text."""
    return f"((('0x' || substr(md5({text}), 1, {DRAW_DIGITS}))::BIGINT)::DOUBLE + 0.5) / {float(16**DRAW_DIGITS)!r}"


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """Mark for broadcast if it has at most so many rows (counted), else leave the join to Spark.

    The caller passes a table of short rows that is computed already (see cut()).
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


@functools.cache
def keep_heap() -> None:
    """Let this process keep the memory that arrays free, as glibc's allocator would otherwise give it back and fault it in again for each numpy expression."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 1 << 28)  # M_MMAP_THRESHOLD
        mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD


def release() -> None:
    """Give what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_arrow(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow() whose workers release() at the end of each task: they stay for later stages, beside their executor's JVM, and would keep the most that any stage took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from part(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)
