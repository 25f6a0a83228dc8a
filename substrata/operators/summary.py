"""Prefix summaries: a tree of counted prefixes as a table, walks on it, training triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from substrata.functions import text as T
from substrata.operators.sampling import in_sequence, weighted_draws

MOST_LENGTH = 20


def generated(strings: DataFrame, generator, string_col: str = "s", start: int = 0) -> DataFrame:
    """(string, frequency): how often the generator (string column -> ARRAY<STRING> column) makes each string, plus start."""
    return strings.select(F.explode(generator(F.col(string_col))).alias("string")).groupBy("string").agg((F.count("*") + start).alias("frequency"))


def words(rows: DataFrame, text_col: str = "s", pattern: str = r"\S+", most: int | None = None) -> DataFrame:
    """(string, frequency) of the words of lower-cased texts; `most`: of so many of the most frequent, of equal ones the first."""
    out = generated(rows, lambda s: F.regexp_extract_all(F.lower(s), F.lit(pattern), F.lit(0)), text_col)
    return out if most is None else in_sequence(out, [F.desc("frequency"), "string"], "place").where(F.col("place") <= most).drop("place")


def tree(strings: DataFrame, string_col: str = "s", most: int = MOST_LENGTH) -> DataFrame:
    """(prefix, parent, depth, frequency): a node starts at 1 and counts each string below it; the root is the empty string, which is no row."""
    nodes = generated(strings, lambda s: T.prefixes(s, most), string_col, start=1)
    return nodes.select(F.col("string").alias("prefix"), F.expr("substring(string, 1, length(string) - 1)").alias("parent"), F.length("string").alias("depth"), "frequency")


def selectivities(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("prefix").alias("string"), F.greatest(F.col("frequency") - 1, F.lit(0)).alias("selectivity"))


def overridden(nodes: DataFrame, cards: DataFrame, most: int = MOST_LENGTH) -> DataFrame:
    """The nodes with frequency card + 1 where cards (prefix, card) has the prefix; nodes of card 0 go, and with them all below."""
    known = cards.where(F.length("prefix") <= most).select("prefix", F.col("card"))
    out = nodes.join(known, "prefix", "left").withColumn("frequency", F.coalesce(F.col("card") + 1, F.col("frequency"))).drop("card")
    return out.where("frequency > 1")


def transitions(nodes: DataFrame) -> DataFrame:
    """(node, other, probability): one step of a walk, to a child by frequency or back to the parent.

    With k children, k / (k + 1) goes to them and 1 / (k + 1) back; the nodes
    right below the root have no way back and give all to their children.
    """
    siblings = Window.partitionBy("parent")
    down = nodes.where("parent <> ''").withColumns({"k": F.count("*").over(siblings), "total": F.sum("frequency").over(siblings)})
    top = F.length("parent") == 1
    part = F.when(top, F.lit(1.0)).otherwise(F.col("k") / (F.col("k") + 1))
    to_child = down.select(F.col("parent").alias("node"), F.col("prefix").alias("other"), F.when(F.col("total") > 0, F.col("frequency") / F.col("total") * part).otherwise(F.lit(0.0)).alias("probability"))
    children = nodes.where("parent <> ''").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("k"))
    up = nodes.where("parent <> ''").select(F.col("prefix").alias("node"), F.col("parent").alias("other")).join(children, "node", "left")
    return to_child.unionByName(up.select("node", "other", (1.0 / (F.coalesce("k", F.lit(0)) + 1)).alias("probability")))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other, weight): ways of one and of two steps, with the product of their probabilities; ways to one node are summed.

    A node has a child for each character at most, so it has as many ways as
    the square of the alphabet at most, whatever the number of strings.
    """
    second = edges.toDF("other", "then", "p2")
    two = edges.join(second, "other").select("node", F.col("then").alias("other"), (F.col("probability") * F.col("p2")).alias("probability"))
    return edges.unionByName(two).groupBy("node", "other").agg(F.sum("probability").alias("weight"))


def walks(edges: DataFrame, k: int, seed: str) -> DataFrame:
    """(node, draw, other): k walks from each node, of one step or two, with equal chance, by the edges' probabilities.

    That is a draw by the weights of neighbours(), as all steps from a node
    that a step leads to add up to 1, without making the pairs of neighbours.
    """
    first = weighted_draws(edges.where("probability > 0"), "node", "other", "probability", k, seed)
    number = lambda *of: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *of)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    first = first.withColumn("two", number(F.lit("steps"), "node", "draw") < 0.5)
    order = Window.partitionBy("node").orderBy("other")
    high = F.sum("probability").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ways = edges.where("probability > 0").withColumns({"high": high, "last": F.row_number().over(order) == F.count("*").over(Window.partitionBy("node"))})
    ways = ways.select(F.col("node").alias("at"), F.col("other").alias("then"), F.when(F.col("last"), 2.0).otherwise(F.col("high")).alias("high"))
    on = first.where("two").withColumn("u", number(F.lit("second"), "node", "draw"))
    on = on.join(ways, F.col("other") == F.col("at")).where("u < high").groupBy("node", "draw").agg(F.min_by("then", F.struct("high", "then")).alias("other"))
    return first.where("NOT two").select("node", "draw", "other").unionByName(on)


def triplets(nodes: DataFrame, k: int = 4, seed: str = "1234") -> DataFrame:
    """(Anchor, draw, Positive, Negative): k of each node. Positives are near on a walk (a lone node is its own), negatives any node.

    A negative is found by its place in the order of the nodes' hashes.
    """
    positive = walks(transitions(nodes), k, seed)
    anchors = nodes.select(F.col("prefix").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("draw"))
    ranked = in_sequence(nodes.select(F.col("prefix").alias("Negative")), [F.md5("Negative"), "Negative"], "rank")
    whole = nodes.agg(F.count("*").alias("whole"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("n"), "node", "draw")), 1, 13), 16, 10).cast("long")
    wanted = anchors.crossJoin(F.broadcast(whole)).withColumn("rank", hashed % F.col("whole") + 1).drop("whole")
    out = wanted.join(ranked, "rank").join(positive, ["node", "draw"], "left")
    return out.select(F.col("node").alias("Anchor"), "draw", F.coalesce("other", "node").alias("Positive"), "Negative")


def pruned(nodes: DataFrame, share: float) -> DataFrame:
    """The floor(share x nodes) nodes of highest frequency, of equal ones the shallower and then the first; a parent is never less frequent than its child, so no node loses its parent."""
    keep = int(nodes.count() * share)
    return in_sequence(nodes, [F.desc("frequency"), "depth", "prefix"], "place").where(F.col("place") <= keep).drop("place")


def below(nodes: DataFrame) -> DataFrame:
    """(prefix, n_below, n_same): nodes at or below each node, and those of them of its own frequency all the way down."""
    up = nodes.select(F.col("prefix").alias("inner"), F.col("frequency").alias("f"), F.explode(T.prefixes("prefix")).alias("prefix"))
    joined = up.join(nodes.select("prefix", "frequency"), "prefix")
    return joined.groupBy("prefix").agg(F.count("*").alias("n_below"), F.sum((F.col("f") == F.col("frequency")).cast("long")).alias("n_same"))


def level_order(nodes: DataFrame) -> Column:
    return F.struct("depth", "prefix")
