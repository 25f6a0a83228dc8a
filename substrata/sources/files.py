"""Readers of string databases, queries, count tables and logs. Schemas are declared; no string is taken for null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from substrata.functions.text import csv_token
from substrata.operators.sampling import in_sequence

_CSV = {"header": "true", "quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def strings(spark: SparkSession, path: str, *, strip: bool = False, keep_empty: bool = False, column: str = "s") -> DataFrame:
    """(s): a string a line. strip: without white space at the end. Lines that aren't valid UTF-8 are left out."""
    rows = spark.read.text(path).select(F.col("value").alias(column)).where(F.is_valid_utf8(F.col(column)))
    if strip:
        rows = rows.withColumn(column, F.regexp_replace(column, r"\s+$", ""))
    return rows if keep_empty else rows.where(F.length(column) > 0)


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(q): a query a line, stripped at the end, repeats kept."""
    return strings(spark, path, strip=True, keep_empty=True, column="q")


def resolved_count(number: str, rows: int) -> int:
    """"0" is all, a number with a point a share (one row at least), another a count."""
    if "." in number:
        return max(int(float(number) * rows), 1)
    return min(int(number), rows) or rows


def some(df: DataFrame, number: str, seed: int = 0) -> DataFrame:
    """A sample of so many rows, see resolved_count(): those of the smallest hash of their values."""
    key = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return in_sequence(df, [F.md5(F.concat(F.lit(f"{seed}:"), F.to_json(key))), F.to_json(key)], "__place").where(F.col("__place") <= resolved_count(number, df.count())).drop("__place")


def counts_long(spark: SparkSession, path: str) -> DataFrame:
    """(word, delta, card) of a file with header "word, delta, card(s)"."""
    return spark.read.options(**_CSV).schema("word string, delta int, card bigint").csv(path)


def prefix_counts_long(spark: SparkSession, path: str) -> DataFrame:
    """(word, delta, cards ARRAY<BIGINT>): the third field is c1:c2:..."""
    rows = spark.read.options(**_CSV).schema("word string, delta int, cards string").csv(path)
    return rows.withColumn("cards", F.split("cards", ":").cast("array<bigint>"))


def counts_wide(spark: SparkSession, path: str, delta: int) -> DataFrame:
    """(word, cards ARRAY<BIGINT>) of a file word,0,1,...; columns beyond delta are dropped."""
    with_all = spark.read.options(**_CSV).csv(path)
    names = ["word", *map(str, range(len(with_all.columns) - 1))]
    return with_all.toDF(*names).select("word", F.array(*[F.col(f"`{k}`").cast("long") for k in range(delta + 1)]).alias("cards"))


def triplets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**_CSV).schema("Anchor string, Positive string, Negative string").csv(path)


def postings(spark: SparkSession, path: str) -> DataFrame:
    """(token, part, rids ARRAY<BIGINT>) of files that write_postings() wrote."""
    rows = spark.read.options(**_CSV).schema("token string, part bigint, rids string").csv(path)
    return rows.withColumn("rids", F.split("rids", " ").cast("array<bigint>"))


def selectivities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**_CSV).schema("string string, selectivity bigint").csv(path)


def _write(df: DataFrame, path: str) -> None:
    df.write.options(header="true", quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").mode("error").csv(path)


def write_counts_long(counts: DataFrame, path: str) -> None:
    """word, delta, card or card1:card2:..., sorted by word and threshold, a file for each range of words."""
    cards = "cards" in counts.columns
    value = F.array_join(F.col("cards").cast("array<string>"), ":") if cards else F.col("card")
    _write(counts.orderBy("word", "delta").select("word", "delta", value.alias("cards" if cards else "card")), path)


def write_counts_wide(table: DataFrame, path: str) -> None:
    _write(table.orderBy("word"), path)


def write_triplets(rows: DataFrame, path: str) -> None:
    _write(rows.select("Anchor", "Positive", "Negative"), path)


def write_postings(rows: DataFrame, path: str) -> None:
    """token, part, ids: a line for each part of a posting list, sorted by token and part."""
    _write(rows.orderBy("token", "part").select("token", "part", F.array_join(F.col("rids").cast("array<string>"), " ").alias("rids")), path)


def write_selectivities(rows: DataFrame, path: str) -> None:
    _write(rows.orderBy("string"), path)


def write_strings(rows: DataFrame, path: str, column: str = "q") -> None:
    """Sorted lines; a folder that is there already stays as it is."""
    rows.select(column).orderBy(column).write.mode("ignore").text(path)


def as_line(counts: DataFrame) -> DataFrame:
    """(line): the long table as text lines with CSV quoting."""
    return counts.select(F.concat_ws(",", csv_token("word"), F.col("delta").cast("string"), F.col("card").cast("string")).alias("line"))


def save_name(stem: str, alg: str, delta: int, prefix_aug: bool) -> str:
    return f"res/{stem}_{alg}_{delta:02d}_{'prefix' if prefix_aug else 'base'}.txt"
