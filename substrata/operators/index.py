"""Token indexes: postings, wildcard n-grams, MinHash signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from substrata.functions import stats as S
from substrata.functions import text as T


#: Ids that a part of a posting list spans.
POSTING_IDS = 1 << 16


def postings(rows: DataFrame, tokens, id_col: str = "rid", span: int = POSTING_IDS) -> DataFrame:
    """(token, part, df, rids): the sorted distinct ids of the rows that hold each token of an array column, and their number.

    Ids are whole numbers. A list is in parts of `span` successive ids, in
    order, so that a token which all rows hold is no single row or task.
    """
    spread = rows.select(id_col, F.explode(F.array_distinct(tokens)).alias("token"))
    parts = spread.groupBy("token", F.floor(F.col(id_col) / span).alias("part")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(id_col)).alias("rids"))
    sizes = parts.groupBy("token").agg(F.sum(F.size("rids")).alias("df"))
    return parts.join(sizes, "token").select("token", "part", "df", "rids")


def _tokens(n: int, string_col: str) -> Column:
    """ARRAY: every substring of length 1..n under every mask of wildcards, distinct.

    A string has up to 2^1 + ... + 2^n of them at each position; substrings
    are made distinct before they are masked.
    """
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(T.substrings(string_col, 1, n)), T.masks)))


def wildcard_ngrams(rows: DataFrame, n: int, id_col: str = "rid", string_col: str = "s") -> DataFrame:
    """(id, token), distinct for rows of distinct ids."""
    return rows.select(id_col, F.explode(_tokens(n, string_col)).alias("token"))


def extended_table(rows: DataFrame, n: int, least: int = 1, string_col: str = "s") -> DataFrame:
    """(token, cnt): in how many rows each wildcard n-gram occurs, if in at least `least`. Equal strings are masked once."""
    weighed = rows.groupBy(F.col(string_col).alias("s")).agg(F.count("*").alias("w"))
    return weighed.select("w", F.explode(_tokens(n, "s")).alias("token")).groupBy("token").agg(F.sum("w").alias("cnt")).where(F.col("cnt") >= least)


def checked(table: DataFrame, least: int) -> DataFrame:
    """The same table; reading a token of fewer than `least` rows is an error."""
    few = F.raise_error(F.concat(F.lit(f"fewer than {least} rows: "), F.col("token"))).cast("long")
    return table.withColumn("cnt", F.when(F.col("cnt") >= least, F.col("cnt")).otherwise(few))


def extended_signatures(rows: DataFrame, n: int, coefficients: list[tuple[int, int]], least: int = 1, id_col: str = "rid", string_col: str = "s") -> DataFrame:
    """The same with signatures: (token, cnt, sig). The smallest hashes are first taken over the rows of each distinct string."""
    names = [f"h{k}" for k in range(len(coefficients))]
    strings = rows.groupBy(F.col(string_col).alias("s")).agg(F.count("*").alias("w"), *[F.min(S.linear_hash(id_col, a, b)).alias(h) for h, (a, b) in zip(names, coefficients, strict=True)])
    spread = strings.select("w", *names, F.explode(_tokens(n, "s")).alias("token"))
    return spread.groupBy("token").agg(F.sum("w").alias("cnt"), *[F.min(h).alias(h) for h in names]).where(F.col("cnt") >= least).select("token", "cnt", F.array(*names).alias("sig"))


HASH_RANGES = 256


def ranks(ids: DataFrame, coefficients: list[tuple[int, int]], id_col: str = "rid") -> DataFrame:
    """(id, r0, r1, ...): the place from 0 of each id in each hashed order.

    Distinct ids below the prime have distinct hashes, so a place is unique.
    Hashes spread evenly, so ids are placed within HASH_RANGES ranges of them,
    each a task, that start where the one before ends. signatures() works on
    the hashes themselves, which give the same minima without any sort.
    """
    out = ids.select(id_col)
    for k, (a, b) in enumerate(coefficients):
        out = out.withColumn("__hash", S.linear_hash(id_col, a, b)).withColumn("__range", F.floor(F.col("__hash") * HASH_RANGES / S.PRIME).cast("int"))
        sizes = out.groupBy("__range").agg(F.count("*").alias("__n"))
        starts = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__start"))  # HASH_RANGES rows
        out = out.withColumn("__nth", F.row_number().over(Window.partitionBy("__range").orderBy("__hash"))).join(F.broadcast(starts), "__range")
        out = out.withColumn(f"r{k}", (F.col("__start") + F.col("__nth") - 1).cast("int")).drop("__hash", "__range", "__nth", "__start")
    return out


def signatures(tokens: DataFrame, coefficients: list[tuple[int, int]], least: int = 1, id_col: str = "rid") -> DataFrame:
    """(token, cnt, sig ARRAY<BIGINT>): the smallest hash of the ids of each token, for each hash function."""
    grouped = tokens.groupBy("token").agg(F.count("*").alias("cnt"), *[F.min(S.linear_hash(id_col, a, b)).alias(f"h{k}") for k, (a, b) in enumerate(coefficients)])
    return grouped.where(F.col("cnt") >= least).select("token", "cnt", F.array(*[f"h{k}" for k in range(len(coefficients))]).alias("sig"))


def top_tokens(tokens: DataFrame, k: int) -> DataFrame:
    """The k tokens of the most rows, of equal ones the first in code-point order."""
    return tokens.groupBy("token").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "token").limit(k)
