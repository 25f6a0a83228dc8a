"""Document fingerprints: threshold-scaled sketches of word shingles.

Every shingle hash below a fixed fraction of the hash range is retained, so
sketches of any two documents can be merged and compared, however unequal the
documents are. A short text may have few hashes there or none: with `floor` its
own bound rises to hold that many of its smallest hashes. The plain sketch has
no floor; the query's has FLOOR, as it must tell short texts apart too. A
sketch states its bound and is complete below it, and two sketches are compared
below the smaller bound.
"""

from __future__ import annotations

import os.path

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from substrata.llm.common import cut, table

SHINGLE_WORDS = 5
FRACTION = 1 / 8
FLOOR = 32
#: Rows that follow each other are dealt out in runs of about so many.
RUN_ROWS, MOST_RUNS = 2_000, 16_384

_TOP = 2**63 - 1


def sketch(df: DataFrame, text: Column, name: str, *, words: int = SHINGLE_WORDS, fraction: float = FRACTION, floor: int = 0) -> DataFrame:
    """Add column `name`: STRUCT<bound BIGINT, hashes ARRAY<BIGINT>>, hashes distinct and ascending.

    Words are lower-cased runs between white space; a text of fewer words than
    a shingle has one shingle of them all. Null, empty and blank texts have no
    hash and the highest bound. floor: a text with fewer hashes below the
    fraction keeps that many of its smallest, or all, and a bound of its own.
    """
    threshold = F.lit(int(-(2**63) + fraction * 2**64))
    word, every, low = (f"__{name}_{x}" for x in ("words", "every", "low"))
    df = df.withColumn(word, F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size(word) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(word, i, words)))
    df = df.withColumn(every, F.when(F.size(word) > 0, shingles).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(low, F.array_sort(F.array_distinct(F.filter(every, lambda h: h < threshold))))
    if floor:
        least = F.array_sort(F.array_distinct(every))
        df = df.withColumn(low, F.when(F.size(low) >= floor, low_struct(threshold, F.col(low))).otherwise(
            F.transform(F.array(least), lambda a: F.when(F.size(a) <= floor, low_struct(F.lit(_TOP), a)).otherwise(low_struct(a[floor - 1] + 1, F.slice(a, 1, floor))))[0]
        ))
    else:
        df = df.withColumn(low, low_struct(F.when(F.size(every) > 0, threshold).otherwise(F.lit(_TOP)), F.col(low)))
    return df.withColumn(name, F.col(low)).drop(word, every, low)


def low_struct(bound: Column, hashes: Column) -> Column:
    return F.struct(bound.cast("bigint").alias("bound"), hashes.alias("hashes"))


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""
    bound = F.least(a["bound"], b["bound"])
    return low_struct(bound, F.filter(F.array_sort(F.array_union(a["hashes"], b["hashes"])), lambda h: h < bound))


def _compared(a: Column, b: Column) -> tuple[Column, Column, Column]:
    bound = F.least(a["bound"], b["bound"])
    x, y = (F.filter(s["hashes"], lambda h: h < bound) for s in (a, b))
    return F.size(F.array_intersect(x, y)), F.size(x), F.size(y)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 of two texts without words, 0 of one with and one without.

    Null if neither has a hash below the common bound though one has words,
    which a floor of 1 or more rules out.
    """
    both, m, n = _compared(a, b)
    whole = (a["bound"] == _TOP) & (b["bound"] == _TOP)
    return F.when(m + n > 0, both / (m + n - both)).when(whole, F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none, null if a has some but none below the common bound, where nothing can be told."""
    both, m, _ = _compared(a, b)
    return F.when(m > 0, both / m).when((F.size(a["hashes"]) == 0) & (a["bound"] == _TOP), F.lit(1.0))


def as_text(s: Column) -> Column:
    """Bound and hashes as 16 hexadecimal digits each."""
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.concat(digits(s["bound"]), F.lit(":"), F.array_join(F.transform(s["hashes"], digits), ""))


def _as_number(df: DataFrame, id_col: str) -> Column:
    """A number that rises with the id, if not always strictly: the id, or six bytes of it as text after what all ids begin with."""
    column = F.col(id_col)
    if df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return column.cast("double")
    ends = df.agg(F.min(column.cast("string")), F.max(column.cast("string"))).first()
    same = len(os.path.commonprefix([(x or "").encode("utf-8", "surrogatepass") for x in ends]))
    digits = F.rpad(F.hex(F.substring(F.encode(column.cast("string"), "UTF-8"), same + 1, 6)), 12, "0")
    return F.conv(digits, 16, 10).cast("double")


def in_runs(df: DataFrame, id_col: str, text_col: str = "text", run_rows: int = RUN_ROWS, most_runs: int = MOST_RUNS) -> DataFrame:
    """Deal rows into runs that follow each other by id, null first, and then by hash of the text: adds run, after (true for a copy of the row that follows the run) and h, the hash.

    Run limits are quantiles of the ids. An id that holds a run or more, the
    null id too, is dealt out by the hashes of its texts. Each run also gets
    the row after its last one: the first row of the next run, or of the first
    run after the last. So whatever needs a row and its successor needs no
    global window. The table of runs has at most twice most_runs rows.
    """
    df = df.withColumns({"number": _as_number(df, id_col), "h": F.xxhash64(text_col)})
    n, nulls = df.agg(F.count("*"), F.sum(F.col(id_col).isNull().cast("long"))).first()
    runs = max(1, min(most_runs, -(-n // run_rows)))
    limits = (df.agg(F.percentile_approx("number", [i / runs for i in range(1, runs)], 20 * runs)).first()[0] or []) if runs > 1 else []
    splits = [float("-inf"), *sorted(set(limits)), float("inf")]
    hot = {x: limits.count(x) + 1 for x in set(limits) if limits.count(x) > 1}
    if hot:  # what is one number may be several ids, whose order comes first
        ids = df.where(F.col("number").isin(list(hot))).groupBy("number").agg(F.min(id_col).alias("a"), F.max(id_col).alias("b")).where("a <=> b").collect()
        hot = {r["number"]: hot[r["number"]] for r in ids}
    width = most_runs + 1
    share = (F.col("h") / F.lit(2.0**64) + 0.5)
    part = lambda k: F.least(F.floor(share * k), F.lit(k - 1)).cast("long")
    parts = F.lit(most_runs).cast("long")  # other ids of the run come after its hot one
    for x, k in hot.items():
        parts = F.when(F.col("number") == x, part(k)).otherwise(parts)
    parts = F.when(F.col(id_col).isNull(), part(max(1, min(most_runs, -(-(nulls or 0) // run_rows))))).otherwise(parts + width)
    bucket = F.lit(0)
    if len(splits) > 2:
        df = Bucketizer(splits=splits, inputCol="number", outputCol="bucket", handleInvalid="keep").transform(df)
        bucket = F.when(F.col(id_col).isNull(), 0).otherwise(F.col("bucket").cast("long"))
    df = df.withColumn("run", bucket * F.lit(2 * width) + parts).drop("number", "bucket")
    order = Window.orderBy("run")
    first = df.groupBy("run").agg(F.min(F.struct(F.col(id_col).isNotNull(), F.col(id_col), F.col("h"))).alias("first"))
    first = first.withColumns({"before": F.lag("run").over(order), "last": F.max("run").over(Window.partitionBy())})
    first = cut(first.select("run", F.col("first")[id_col].alias("first_id"), F.col("first.h").alias("first_h"), F.coalesce("before", "last").alias("before")))
    df = df.join(F.broadcast(first), "run")
    here, there = F.struct(F.col("run").alias("r"), F.lit(False).alias("a")), F.struct(F.col("before").alias("r"), F.lit(True).alias("a"))
    is_first = F.col(id_col).eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    df = df.withColumn("place", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))))
    return df.withColumns({"run": F.col("place.r"), "after": F.col("place.a")}).drop("place", "first_id", "first_h", "before")


def op4_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"), floor=FLOOR)


def fingerprint_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", floor: int = FLOOR, **options) -> DataFrame:
    """Fingerprint every text and its edited text: its last floor(n/2) code points give way to the first of the next document.

    Next: in ascending id (null ids first, rows of one id by hash and then
    text), the first after the last; a lone document follows itself. Ids may
    be of any kind that has an order. Null texts are empty. Texts are hashed
    whole. floor=0 leaves the plain sketch, which can't tell short texts apart.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (Jaccard) and held_edited, the share of the text's
    shingles that the edited text has, null where containment() can't tell.
    Empty table: no rows.
    """
    df = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = in_runs(df, "doc_id")
    options["floor"] = floor
    order = Window.partitionBy("run").orderBy("after", F.col("doc_id").asc_nulls_first(), "h", "text")
    df = df.withColumn("following", F.coalesce(F.lead("text").over(order), F.lit("")))
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("following"), F.lit(1), half))
    df = df.withColumn("edited", F.when(F.col("after"), F.lit("")).otherwise(edited)).drop("following")
    df = sketch(sketch(df, F.col("text"), "own", **options), F.col("edited"), "other", **options)
    df = df.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    df = df.withColumn("next", F.lead("own").over(order)).where(~F.col("after"))
    return df.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"), containment(F.col("own"), F.col("other")).alias("held_edited"),
    )
