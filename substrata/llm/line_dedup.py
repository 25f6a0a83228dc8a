"""Line dedup over overlapping windows of three lines.

The hash of every three consecutive lines is looked up in all documents. The
first occurrence stays, by document id and then position; the lines of later
ones go, where windows that overlap cover a line once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from substrata.llm.common import cut, table

WINDOW_LINES = 3


def window_hashes(lines: Column, width: int) -> Column:
    """ARRAY<STRUCT<p INT, a BIGINT, b BIGINT>>: 128 bits for each window, p the index of its first line in `lines`."""
    hashed = lambda i: F.struct(
        (i - 1).cast("int").alias("p"),
        F.xxhash64(F.slice(lines, i, width)).alias("a"),
        F.xxhash64(F.lit(1), F.slice(lines, i, width)).alias("b"),
    )
    return F.when(F.size(lines) >= width, F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines) - (width - 1), F.lit(1))), hashed)).otherwise(F.array().cast("array<struct<p:int,a:bigint,b:bigint>>"))


def removals(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW_LINES) -> DataFrame:
    """(doc_id, text_hash, gone ARRAY<INT>): documents that lose lines, and which of their non-blank lines.

    Only hashes, ids and positions are shuffled. A window that a third of all
    documents have is one row in the table of repeated windows, counted before
    the shuffle; that table is computed first, so that Spark can split the
    occurrences of such a window in the join back to them.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _solid("text").alias("lines"))
    spots = docs.select("doc_id", "text_hash", F.explode(window_hashes(F.col("lines"), width)).alias("w")).select("w.a", "w.b", "doc_id", "text_hash", "w.p")
    known = F.struct(F.col("doc_id").isNotNull().alias("k"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("p"))
    repeated = cut(spots.groupBy("a", "b").agg(F.min(known).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first"))
    later = spots.join(repeated, ["a", "b"]).where(~known.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("p").alias("starts")).select("doc_id", "text_hash", F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + width - 1)))).alias("gone"))


def _solid(text: str) -> Column:
    """The lines that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r ]+", " "))), lambda x: x != "")


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW_LINES) -> DataFrame:
    """Return (doc_id, n_lines, n_removed, text) for every row, the text without the lines removed.

    Windows are of consecutive non-blank lines, compared with runs of spaces
    and tabs as one space; blank lines are never removed. A text of fewer
    non-blank lines than a window keeps them all. Null text: no lines, null
    stays. Rows that are equal in id and text count as one occurrence and
    lose the same lines. Empty table: no rows.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    gone = removals(df, id_col=id_col, text_col=text_col, width=width).toDF("gone_id", "gone_hash", "gone")
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    out = out.withColumn("raw", F.when(F.col("text").isNotNull(), F.split("text", "\n")))
    solid = lambda x: F.trim(F.regexp_replace(x, r"[\t\r ]+", " ")) != ""
    at = F.filter(F.transform("raw", lambda x, i: F.when(solid(x), i)), lambda i: i.isNotNull())
    out = out.withColumn("at", F.when(F.col("text").isNotNull(), at)).withColumn("n_lines", F.coalesce(F.size("at"), F.lit(0)).cast("long"))
    # set difference by hashing keeps the order, and is linear in the lines of a text
    stay = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), F.transform("gone", lambda g: F.element_at("at", g + 1)))
    text = F.array_join(F.transform(stay, lambda i: F.element_at("raw", i + 1)), "\n")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return out.select("doc_id", "n_lines", n_removed.alias("n_removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(text).alias("text"))


def op7_window_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


ORACLE = """
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS spot, unnest(string_split(text, chr(10))) AS row_text FROM documents),
    s AS (SELECT doc_id, spot, row_text, trim(regexp_replace(row_text, '[\\t\\r ]+', ' ', 'g')) AS norm FROM l),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS p FROM s WHERE norm <> ''),
    w AS (SELECT doc_id, p, norm || chr(10) || lead(norm) OVER d || chr(10) || lead(norm, 2) OVER d AS win FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
    r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS nth FROM w WHERE win IS NOT NULL),
    g AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS p FROM r WHERE nth > 1),
    k AS (SELECT s.doc_id, string_agg(s.row_text, chr(10) ORDER BY s.spot) FILTER (g.p IS NULL) AS text, count(p.p) AS n_lines, count(g.p) AS n_removed
          FROM s LEFT JOIN p ON s.doc_id = p.doc_id AND s.spot = p.spot LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p GROUP BY s.doc_id)
    SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
           CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
    FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"""
