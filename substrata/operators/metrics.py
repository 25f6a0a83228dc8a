"""Errors of estimates and reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from substrata.functions import stats as S
from substrata.operators.sampling import in_sequence

#: The levels that reports list.
LEVELS = (0.10, 0.20, 0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 0.75, 0.80, 0.90, 0.95, 0.99, 1.0)


def with_errors(rows: DataFrame, y: str = "card", estimate: str = "estimate", eps: float = 10.0) -> DataFrame:
    return rows.withColumns({"q_err": S.q_error(y, estimate), "q_err_eps": S.q_error_eps(y, estimate, eps), "log10_err": S.log10_error(y, estimate), "msle": S.squared_log_error(y, estimate)})


def not_finite(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose value is no finite number, with the problem: null, nan or infinite."""
    c = F.col(column).cast("double")
    problem = F.when(c.isNull(), "null").when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), "infinite")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL")


def summary(rows: DataFrame, column: str = "q_err") -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("most"))


def quantiles(rows: DataFrame, column: str = "q_err", levels: tuple[float, ...] = LEVELS, accuracy: int | None = None) -> DataFrame:
    """(level, value): exact, with linear interpolation; with an accuracy, from sketches whose size doesn't grow with the rows.

    Exact: equal values are counted, the counts summed in the order of the
    values, and the two values about each level looked up. Nulls are left out.
    """
    at = F.array(*[F.lit(x) for x in levels])
    if accuracy is None:
        values = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
        values = in_sequence(values, ["value"], "place", "upto", "n")
        wanted = values.agg(F.max("upto").alias("whole")).select(F.explode(at).alias("level"), "whole").withColumn("spot", F.col("level") * (F.col("whole") - 1))
        held = lambda spot: (F.col("upto") - F.col("n") <= spot) & (spot < F.col("upto"))
        low, high = F.floor("spot"), F.ceil("spot")
        near = values.join(F.broadcast(wanted), held(low) | held(high)).groupBy("level", "spot").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        return near.select("level", (F.col("low") + (F.col("spot") - F.floor("spot")) * (F.col("high") - F.col("low"))).alias("value"))
    found = rows.agg(F.percentile_approx(column, at, accuracy).alias("v"))
    return found.select(F.explode(F.arrays_zip(at.alias("level"), F.col("v").alias("value"))).alias("e")).select(F.col("e.level").alias("level"), F.col("e.value").alias("value"))


def crosstab(rows: DataFrame, row: str = "delta", column: str = "len", values: tuple[str, ...] = ("q_err", "q_err_eps")) -> DataFrame:
    """(row, column, n, mean of each value) with totals, where row or column is null."""
    return rows.cube(row, column).agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def weighted_mean(rows: DataFrame, value: str, weight: str):
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)
