"""Estimates of approximate substring counts from wildcard n-gram statistics.

A string is within delta edits of a query at some place if it holds one of the
query's minimal patterns: the query after delta deletions, replacements and
insertions, the latter two as wildcards. The size of the union of the
patterns' string sets is estimated from the largest set and MinHash.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from substrata.functions import stats as S
from substrata.functions.text import WILDCARD
from substrata.operators import index

NGRAM, LEAST, HASHES = 5, 20, 10
#: More edit scripts than this are refused; none is left out.
MOST_SCRIPTS = 200_000
_MARK = -1


@functools.lru_cache(None)
def scripts(n: int, d: int) -> tuple[tuple[int, ...], ...]:
    """Ways to apply exactly d edits to n characters: the places kept, _MARK for a wildcard.

    A way whose pattern some kept way's pattern occurs in goes.
    """
    letter = lambda w: "".join("?" if k == _MARK else chr(0x1000 + k) for k in w)
    ways: dict[str, tuple[int, ...]] = {}
    for gone, new in itertools.product(range(d + 1), repeat=2):
        other = d - gone - new
        if other < 0 or gone + other > n:
            continue
        for w in _placements(n, gone, new, other):
            ways[letter(w)] = w
            if len(ways) > MOST_SCRIPTS:
                raise ValueError(f"more than {MOST_SCRIPTS} ways to apply {d} edits to {n} characters")
    return tuple(ways[p] for p in _least(sorted(ways, key=lambda p: (len(p), p)), "?"))


def _placements(n: int, deleted: int, inserted: int, replaced: int) -> Iterator[tuple[int, ...]]:
    for new in itertools.combinations(range(n + inserted), inserted):
        old = [k for k in range(n + inserted) if k not in new]  # slots of the characters in order
        for gone in itertools.combinations(range(n), deleted):
            left = [k for k in range(n) if k not in gone]
            for other in itertools.combinations(left, replaced):
                out = dict.fromkeys(new, _MARK) | {old[k]: _MARK if k in other else k for k in left}
                yield tuple(out[slot] for slot in sorted(out))


def _general(pattern: str, wildcard: str) -> re.Pattern:
    return re.compile("".join("." if x == wildcard else re.escape(x) for x in pattern), re.S)


def _least(patterns: list[str], wildcard: str, verbatim: bool = False, same_length: bool = False) -> list[str]:
    """Those in which no kept one before occurs; the patterns come sorted."""
    out: list[tuple[str, re.Pattern]] = []
    for p in patterns:
        if verbatim:
            if any(k in p for k, _ in out):
                continue
        elif any((not same_length or len(k) == len(p) and wildcard in k) and g.search(p) for k, g in out):
            continue
        out.append((p, _general(p, wildcard)))
    return [k for k, _ in out]


@functools.lru_cache(100_000)
def minimal_patterns(query: str, d: int) -> tuple[str, ...]:
    """Distinct patterns by length and then code point, without those that a shorter or more general one stands for."""
    made = {"".join(WILDCARD if k == _MARK else query[k] for k in w) for w in scripts(len(query), d)}
    # a wildcard sorts before all characters
    order = sorted(made, key=lambda p: (len(p), p.replace(WILDCARD, "\0")))
    return tuple(_least(_least(order, WILDCARD, verbatim=True), WILDCARD, same_length=True))


def patterns(queries: DataFrame) -> DataFrame:
    """(q, delta, ord, pattern) of the distinct (q, delta)."""

    @F.pandas_udf("array<string>")
    def made(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([list(minimal_patterns(a, int(b))) for a, b in zip(q, d, strict=True)])

    return queries.select("q", "delta").distinct().select("q", "delta", F.posexplode(made("q", "delta")).alias("ord", "pattern"))


def build(rows: DataFrame, n: int = NGRAM, least: int = LEAST, hashes: int = HASHES, seed: int = 0, id_col: str = "rid", string_col: str = "s") -> DataFrame:
    """(token, cnt, sig): wildcard n-grams in `least` rows or more, and the empty token with the number of all rows."""
    table = index.extended_signatures(rows, n, S.hash_coefficients(hashes, seed), least, id_col, string_col)
    empty = rows.agg(F.count("*").alias("cnt")).select(F.lit("").alias("token"), "cnt", F.array_repeat(F.lit(0).cast("long"), hashes).alias("sig"))
    return table.unionByName(empty)


def _folded(fold, sig: str, hashes: int) -> Column:
    return F.array(*[fold(F.col(sig)[k]) for k in range(hashes)])


def pattern_counts(found: DataFrame, table: DataFrame, n: int = NGRAM, hashes: int = HASHES) -> DataFrame:
    """(q, delta, ord, pattern, freq, sig) of the patterns that have an estimate.

    Up to n characters a pattern is looked up. A longer one is a chain of its
    windows: the product of their counts, each over the count of its overlap
    with the next, in order; the signature is the largest hash of each window.
    """
    looked = found.where(F.length("pattern") <= n).join(table, F.col("pattern") == F.col("token")).select("q", "delta", "ord", "pattern", F.col("cnt").cast("double").alias("freq"), "sig")
    long = found.where(F.length("pattern") > n).withColumn("windows", F.length("pattern") - (n - 1))
    long = long.select("*", F.explode(F.sequence(F.lit(1), F.col("windows"))).alias("pos")).withColumn("token", F.expr(f"substring(pattern, pos, {n})"))
    counts = table.select("token", "cnt", "sig")
    over = table.select(F.col("token").alias("overlap"), F.col("cnt").alias("over"))
    long = long.join(counts, "token").withColumn("overlap", F.substring("token", 1, n - 1)).join(over, "overlap")
    steps = F.sort_array(F.collect_list(F.struct("pos", "cnt", "over")))
    chained = long.groupBy("q", "delta", "ord", "pattern", "windows").agg(steps.alias("steps"), _folded(F.max, "sig", hashes).alias("sig")).where(F.size("steps") == F.col("windows"))
    freq = F.aggregate("steps", F.lit(1.0), lambda f, s: F.when(s["pos"] == 1, s["cnt"].cast("double")).otherwise(f * (s["cnt"] / s["over"])))
    return looked.unionByName(chained.select("q", "delta", "ord", "pattern", freq.alias("freq"), "sig"))


def estimate(queries: DataFrame, table: DataFrame, coverage: float = 1.0, n: int = NGRAM, hashes: int = HASHES) -> DataFrame:
    """(q, delta, most, pattern, share, estimate) for each (q, delta).

    The largest pattern's count over the share of the union that its
    signature agrees with; coverage stands in for a share of 0. Queries
    without a counted pattern are estimated at 0.
    """
    counted = pattern_counts(patterns(queries), table, n, hashes)
    best = F.max_by(F.struct("freq", "sig", "pattern"), F.struct("freq", -F.col("ord")))
    grouped = counted.groupBy("q", "delta").agg(best.alias("best"), _folded(F.min, "sig", hashes).alias("whole"))
    grouped = grouped.withColumn("share", S.equal_share("best.sig", "whole"))
    out = queries.join(grouped, ["q", "delta"], "left")
    share = F.when(F.col("share") == 0, F.lit(float(coverage))).otherwise(F.col("share"))
    return out.select("q", "delta", F.coalesce("best.freq", F.lit(0.0)).alias("most"), F.col("best.pattern").alias("pattern"), F.coalesce(share, F.lit(0.0)).alias("share"), F.coalesce(F.col("best.freq") / share, F.lit(0.0)).alias("estimate"))


def coverage(truth: DataFrame, table: DataFrame, sample: int = 100, n: int = NGRAM, hashes: int = HASHES, seed: str = "0") -> float:
    """Mean of largest pattern count over true count, over a hashed sample of (q, delta, card); zeros are left out."""
    drawn = truth.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "q", "delta")), "q", "delta").limit(sample).where("card > 0")
    counted = pattern_counts(patterns(drawn.select("q", "delta")), table, n, hashes).groupBy("q", "delta").agg(F.max("freq").alias("most"))
    found = drawn.join(counted, ["q", "delta"]).where("most > 0").agg(F.avg(F.col("most") / F.col("card"))).first()[0]
    return 1.0 if found is None else float(found)


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")
