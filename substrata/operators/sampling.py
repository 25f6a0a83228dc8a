"""Splits and samples that depend on hashed keys alone: every run and every engine draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from substrata.functions import text as T
from substrata.sources.work import cut


def in_sequence(rows: DataFrame, order: list[Column | str], place: str, so_far: str | None = None, value: Column | str | None = None) -> DataFrame:
    """Add `place`, from 1, of each row in that order, and `so_far`, the sum of the value up to it.

    The rows are sorted in ranges, one a task, and kept so; each range starts
    where the one before ends, which takes one row a range to tell. Names of
    columns that begin with two underscores are the operator's own.
    """
    value = F.lit(0) if value is None else F.col(value) if isinstance(value, str) else value
    rows = cut(rows.withColumn("__value", value).sort(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sums = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), F.sum("__value").alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sums.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__sum_before"))
    rows = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    added = {place: F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1}
    if so_far:
        added[so_far] = F.col("__sum_before") + F.sum("__value").over(Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns(added).drop("__value", "__id", "__part", "__start", "__sum_before")


def order_key(column: str, seed: str = "0") -> Column:
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(column)))


def _shares(rows: DataFrame, stratum: str, share: float, name: str) -> DataFrame:
    """(stratum, n, name): how many of each stratum, by largest remainder, so that the total is the share of all rows rounded up."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    quota = F.col("n") * F.lit(share)
    out = sizes.withColumn("whole", F.floor(quota)).withColumn("rest", quota - F.floor(quota))
    out = out.withColumn("missing", F.ceil(F.sum("n").over(every) * F.lit(share) - F.lit(1e-9)) - F.sum("whole").over(every))
    place = F.row_number().over(Window.orderBy(F.desc("rest"), stratum))  # one row a stratum
    return out.withColumn(name, (F.col("whole") + F.when(place <= F.col("missing"), 1).otherwise(0)).cast("long")).select(stratum, name)


def numbered(rows: DataFrame, stratum: str, column: str, seed: str, place: str, n: str | None = None) -> DataFrame:
    """Add `place`, from 1, of each row within its stratum by order_key(), and `n`, the size of the stratum.

    Rows are numbered within the first two digits of the key, which sort as the
    key does, and each part starts where the one before ends: a stratum that
    holds a third of all rows is numbered in 256 tasks.
    """
    rows = rows.withColumn("__key", order_key(column, seed)).withColumn("__part", F.substring("__key", 1, 2))
    parts = rows.groupBy(F.col(stratum).alias("__of"), F.col("__part").alias("__in")).agg(F.count("*").alias("__size"))
    whole = Window.partitionBy("__of")
    parts = parts.withColumn("__start", F.sum("__size").over(whole.orderBy("__in")) - F.col("__size")).withColumn("__n", F.sum("__size").over(whole))
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(stratum, "__part").orderBy("__key", column)))
    rows = rows.join(parts, F.col(stratum).eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__in")))
    added = {place: F.col("__start") + F.col("__nth")} | ({n: F.col("__n")} if n else {})
    return rows.withColumns(added).drop("__key", "__part", "__of", "__in", "__size", "__start", "__n", "__nth")


def three_way(rows: DataFrame, column: str = "q", *, p_test: float = 0.1, p_valid: float = 0.1, seed: str = "0") -> DataFrame:
    """Add `split`: test, valid or train, stratified by string length. valid is a share of all rows, drawn from what test leaves."""
    rows = rows.withColumn("len", F.length(column).cast("long"))
    tests = _shares(rows, "len", p_test, "n_test")
    rows = numbered(rows, "len", column, seed, "place").join(tests, "len")
    rest = rows.where("place > n_test")
    valids = _shares(rest, "len", p_valid / (1 - p_test), "n_valid")
    rows = rows.join(valids, "len", "left")
    split = F.when(F.col("place") <= F.col("n_test"), "test").when(F.col("place") <= F.col("n_test") + F.coalesce("n_valid", F.lit(0)), "valid").otherwise("train")
    return rows.withColumn("split", split).drop("place", "n_test", "n_valid", "len")


def down_sample(rows: DataFrame, p: float, column: str = "q", seed: str = "0") -> DataFrame:
    """Of each string length the share p, one row at least."""
    rows = numbered(rows.withColumn("__len", F.length(column)), "__len", column, seed, "__place", "__whole")
    return rows.where(F.col("__place") <= F.greatest(F.lit(1), F.floor(F.col("__whole") * F.lit(p)))).drop("__len", "__place", "__whole")


def first_seen(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with the least `order` of each, to sort them by."""
    return rows.groupBy(column).agg(F.min(order).alias("first"))


def within_prefix_budget(queries: DataFrame, most: int, column: str = "q", order: str = "qid") -> DataFrame:
    """The queries, in order, for which the number of distinct prefixes so far is at most `most`."""
    new = queries.select(order, F.explode(T.prefixes(column)).alias("prefix")).groupBy("prefix").agg(F.min(order).alias(order)).groupBy(order).agg(F.count("*").alias("new"))
    out = in_sequence(queries.join(new, order, "left"), [order], "__place", "n_prefixes", F.coalesce("new", F.lit(0)))
    return out.where(F.col("n_prefixes") <= most).drop("new", "__place")


def prefix_slots(queries: DataFrame, column: str = "q", order: str = "qid") -> DataFrame:
    """(prefix, slot): distinct prefixes numbered from 1 as the queries, in order, bring them, the shortest first."""
    first = queries.select(order, F.explode(T.prefixes(column)).alias("prefix")).groupBy("prefix").agg(F.min(order).alias(order))
    return in_sequence(first, [order, F.length("prefix")], "slot").select("prefix", "slot")


def rows_of(values: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """The values, with their other columns, and what the table (column, ...) has for each; one that isn't there is an error."""
    known = table.withColumn("__there", F.lit(True))
    found = values.join(known, column, "left")
    missing = F.raise_error(F.concat(F.lit("not in the table: "), F.col(column).cast("string"))).cast("boolean")
    return found.where(F.coalesce("__there", missing)).drop("__there")


def without_replacement(rows: DataFrame, k: int, column: str, seed: str = "0") -> DataFrame:
    """The k rows of the smallest order_key(), wherever they are: no task holds all of them."""
    return in_sequence(rows, [order_key(column, seed), column], "__place").where(F.col("__place") <= k).drop("__place")


def weighted_draws(edges: DataFrame, node: str, other: str, weight: str, k: int, seed: str = "0") -> DataFrame:
    """k draws with replacement for each node from its edges, by weight: (node, draw, other)."""
    order = Window.partitionBy(node).orderBy(other)
    total = Window.partitionBy(node)
    edges = edges.withColumn("__high", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(total)).withColumn("__low", F.col("__high") - F.col(weight) / F.sum(weight).over(total))
    edges = edges.withColumn("__last", F.row_number().over(order) == F.count("*").over(total))
    draws = edges.select(node, other, "__low", "__high", "__last", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("draw"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(node), F.col("draw"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    hit = (u >= F.col("__low")) & ((u < F.col("__high")) | F.col("__last"))
    return draws.where(hit).groupBy(node, "draw").agg(F.min(other).alias(other))
