"""Character dictionaries and model inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from substrata.functions import text as T

PAD, UNKNOWN, FIRST = 0, 1, 2


def char_counts(strings: DataFrame, string_col: str = "s") -> DataFrame:
    return strings.select(F.explode(T.chars(string_col)).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))


def char_dictionary(strings: DataFrame, most: int | None = None, string_col: str = "s") -> DataFrame:
    """(ch, n, id): ids from 2 by falling count, of equal ones in code-point order, of the `most` most frequent. An alphabet is small."""
    out = char_counts(strings, string_col).withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "ch")) + (FIRST - 1))
    return out if most is None else out.where(F.col("id") < FIRST + most)


def alphabet(strings: DataFrame, string_col: str = "s") -> DataFrame:
    """(ch, id): the distinct characters in code-point order, ids from 0."""
    return char_counts(strings, string_col).select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).alias("id"))


def strictly_encoded(string_col: str, codes: Column) -> Column:
    """ARRAY<INT> of ids; a character that the alphabet lacks is an error."""
    return F.transform(T.chars(string_col), lambda x: F.coalesce(F.try_element_at(codes, x), F.raise_error(F.concat(F.lit("not in the alphabet: "), x)).cast("int")))


def lookup(dictionary: DataFrame) -> Column:
    """A MAP literal of the dictionary (fetched: one row a character)."""
    rows = dictionary.select("ch", "id").collect()
    return F.map_from_arrays(F.array(*[F.lit(r["ch"]) for r in rows]), F.array(*[F.lit(r["id"]) for r in rows])) if rows else F.create_map().cast("map<string,int>")


def encoded(string_col: str, codes: Column, shift: int = 0) -> Column:
    """ARRAY<INT> of ids, UNKNOWN for characters that the dictionary lacks."""
    return F.transform(T.chars(string_col), lambda x: F.coalesce(F.try_element_at(codes, x), F.lit(UNKNOWN)) + shift)


def decoded(ids: Column, dictionary: DataFrame) -> Column:
    rows = dictionary.select("ch", "id").collect()
    names = F.map_from_arrays(F.array(*[F.lit(r["id"]) for r in rows]), F.array(*[F.lit(r["ch"]) for r in rows]))
    return F.array_join(F.transform(ids, lambda k: F.coalesce(F.try_element_at(names, k), F.lit(""))), "")


def packed(sequences: DataFrame, ids_col: str, length_col: str, keep: list[str]) -> DataFrame:
    """One row for each of the first `length` entries of each sequence, with its place from 0."""
    return sequences.select(*keep, F.posexplode(F.expr(f"slice({ids_col}, 1, {length_col})")).alias("pos", "id"))
