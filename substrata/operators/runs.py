"""The table of experiments, and the relational work behind its reports."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "tbl string, exp_key string, value string, at bigint"
STATUS = {0: "fail", 1: "start", 2: "done", 3: "timeout"}


def latest(runs: DataFrame) -> DataFrame:
    """The last value written of each (tbl, exp_key)."""
    return runs.groupBy("tbl", "exp_key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def field(value: str, name: str, kind: str = "string") -> Column:
    return F.get_json_object(value, f"$.{name}").cast(kind)


def matches(row: dict[str, str], query: dict) -> Column:
    """A query on columns: a scalar is equal to, a list holds, '*' takes anything that is there. row: name -> column name."""
    out = F.lit(True)
    for name, wanted in query.items():
        if name not in row:
            return F.lit(False)
        c = F.col(row[name])
        out &= c.isNotNull() if wanted == "*" else c.isin(wanted) if isinstance(wanted, list) else c == F.lit(wanted)
    return out


def expanded(spark: SparkSession, options: dict) -> DataFrame:
    """One row for each combination of the list-valued options."""
    lists = [v if isinstance(v, list) else [v] for v in options.values()]
    return spark.createDataFrame([tuple(map(str, x)) for x in itertools.product(*lists)], ", ".join(f"`{k}` string" for k in options))


def command_line(options: list[str]) -> Column:
    """The options, in order, as one key: --name value for each column that isn't null."""
    return F.concat_ws(" ", *[F.when(F.col(o).isNotNull(), F.concat(F.lit(f"--{o} "), F.col(o).cast("string"))) for o in options])


def lookup(params: DataFrame, key: Column, records: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows of params with the metrics wanted, name -> (table, JSON field), of the records under their key.

    Rows that lack a metric, or whose record holds a traceback, are left out.
    """
    out = params.withColumn("__key", key)
    for name, (tbl, path) in wanted.items():
        one = records.where((F.col("tbl") == tbl) & ~F.col("value").contains("Traceback")).select(F.col("exp_key").alias("__key"), field("value", path, "double").alias(name)).where(F.col(name).isNotNull())
        out = out.join(one, "__key")
    return out.drop("__key")


def clipped(rows: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Without the rows outside the range; nulls and NaN stay."""
    c = F.col(column)
    inside = F.lit(True)
    if low is not None:
        inside &= ~F.coalesce((c < low) & ~F.isnan(c), F.lit(False))
    if high is not None:
        inside &= ~F.coalesce((c > high) & ~F.isnan(c), F.lit(False))
    return rows.where(inside)


def aggregated(rows: DataFrame, over: str, values: list[str], count: bool = True) -> DataFrame:
    """Group by all columns but `over` and the values: mean and sample deviation of each value, and the number of rows."""
    keys = [c for c in rows.columns if c != over and c not in values]
    stats = [f(v).alias(f"{v}_{name}") for v in values for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return rows.groupBy(*keys).agg(*stats, *([F.count("*").alias("n")] if count else []))


def pivoted(rows: DataFrame, row: str, across: str, names: list[str], value: str) -> DataFrame:
    return rows.groupBy(row).pivot(across, names).agg(F.first(value))


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def labelled(column: str, names: dict[str, str]) -> Column:
    """The label of a value, or the value itself."""
    out = F.col(column)
    for value, label in names.items():
        out = F.when(F.col(column) == value, label).otherwise(out)
    return out


# The fields of the log lines, in order.
_TIMING = r"^(\S+ \S+) (\S+) (\d+) (\d+) (\d+) (\d+) (\S+) (\S+)$"
_WORK = r"^(\S+ \S+) (\d+) (\d+) (\d+) (\d+) (\d+) (\d+)$"


def timings(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed run times; a time of 0 or less marks a run that hasn't ended and is null."""
    g = lambda k: F.regexp_extract(column, _TIMING, k)
    time = g(8).cast("double")
    return lines.where(F.col(column).rlike(_TIMING)).select(g(1).alias("log_time"), g(2).alias("alg"), g(3).cast("long").alias("n_qry"), g(4).cast("long").alias("n_rec"), g(5).cast("long").alias("n_prfx"), g(6).cast("int").alias("d"), F.lower(g(7)).isin("true", "1").alias("p"), F.when(time > 0, time).alias("time"))


def work_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    names = ("total_line", "computed_line", "pruned_line", "total_cell", "computed_cell", "pruned_cell")
    g = lambda k: F.regexp_extract(column, _WORK, k)
    return lines.where(F.col(column).rlike(_WORK)).select(g(1).alias("log_time"), *[g(k).cast("long").alias(n) for k, n in enumerate(names, 2)])


def place_in(column: str, names: list[str]) -> Column:
    """The place of a value in a list, from 1; others after the last."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))
    return F.when(place == 0, len(names) + 1).otherwise(place)


def in_order(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Sorted by the place of a value in a list; others last."""
    return rows.orderBy(place_in(column, names), column)


def nth(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__nth") <= n).drop("__nth")
