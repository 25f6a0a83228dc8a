"""Mixing sources to target weights.

Tokens are summed per source, targets shared out by weight, and a source's
repetition rate is its target over its size. A document is emitted floor(rate)
times, and once more by a Bernoulli draw: if a number hashed from its id is
below the fraction of the rate.

Of a source of few documents these draws miss the target, of 50 documents by
up to 47 percent of it. So a named second step, settle, mends the draw of the
same numbers where it missed: the words drawn are also summed by bins of the
numbers, and documents whose number lies between the fraction and the bin's
edge up to which the words come nearest the target change sides. That step
touches no more words than the draw was off by and half a bin, and the limit
nears the fraction as sources grow; settle=False leaves the plain draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from substrata.llm.common import cut, draw, id_text, small, sql_draw, table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix"
#: Tables of so many sources at most are broadcast; rows are a name and three numbers.
BROADCAST_SOURCES = 20_000
#: Bins of the drawn numbers: a large source meets its target to half of 1 in so many, a small one to half a document.
BINS = 4096
#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] | dict[str | None, float] = WEIGHTS, most_repeats: float = MOST_REPEATS) -> DataFrame:
    """From (source, source_size), one row each: (source, source_size, target, rate).

    weights: by source, or a list that sources in code-point order, null last,
    take over and over. Sources without a weight, or of weight 0, have target 0.
    Water level: a source takes level x weight, or its cap if that is less.
    Sorted by cap / weight, the capped sources come first, so running sums
    find the level at once instead of by repeated sharing. The sorts run over
    one row a source. Where all are capped, less than all sizes is shared.
    """
    if isinstance(weights, dict):
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
        out = sizes.withColumns({"weight": weight, "rank": F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))})
    else:
        out = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
        out = out.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    every = Window.partitionBy()
    out = out.withColumn("all", F.sum(F.col("source_size").cast("double")).over(every))
    without = out.where("weight <= 0").select("source", "source_size", F.lit(0.0).alias("target"), F.lit(0.0).alias("rate"))
    out = out.where("weight > 0").withColumn("cap", F.col("source_size").cast("double") * F.lit(float(most_repeats)))
    out = out.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    out = out.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    out = out.withColumn("capped", F.col("ratio") <= F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    out = out.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return out.select("source", "source_size", "target", rate.alias("rate")).unionByName(without)


def limits(bins: DataFrame, rates: DataFrame) -> DataFrame:
    """From (source, bin, size) and targets(): (source, source_size, target, whole, limit), whole = floor(rate).

    Documents whose number is below limit get a copy more: the bins whose
    middle is within the words that whole repetitions leave are the first
    ones, and bins without words are in none. A source has BINS rows at most.
    """
    rates = rates.withColumn("whole", F.floor("rate")).withColumn("need", F.col("target") - F.floor("rate") * F.col("source_size"))
    known = bins.withColumnRenamed("source", "of").join(small(rates, BROADCAST_SOURCES), F.col("of").eqNullSafe(F.col("source"))).drop("of")
    middle = F.sum("size").over(Window.partitionBy("source").orderBy("bin")) - F.col("size") / 2
    known = known.withColumn("inside", (middle <= F.col("need")) & (F.col("size") > 0) & (F.col("need") > 0))
    return known.groupBy("source", "source_size", "target", "whole").agg((F.coalesce(F.max(F.when(F.col("inside"), F.col("bin") + 1)), F.lit(0)) / F.lit(float(BINS))).alias("limit"))


def with_copies(df: DataFrame, weights: tuple[float, ...] | dict[str | None, float] = WEIGHTS, *, most_repeats: float = MOST_REPEATS, seed: str = SEED, settle: bool = True, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, size, source_size, target, copies) of every row; row is a struct of its columns, whatever their names.

    settle: whether the draws of a source are mended to meet its target, see
    above. Null texts have size 0; null sources are one source, the last.
    Sources of target 0, as those of size 0, have no copies. Documents without
    words are copied as the draw says and never more than ceil(rate) times.
    Rows of one id draw alike, rows without an id as one id. Repeated rows
    count each. Long texts are counted whole. Empty table: no rows.
    """
    number = draw(seed, id_text(id_col))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), words(F.col(text_col)).alias("size"), F.col(source_col).alias("of"), number.alias("number"))
    bins = cut(rows.groupBy(F.col("of").alias("source"), F.floor(F.col("number") * BINS).cast("int").alias("bin")).agg(F.sum("size").alias("size")))
    rates = cut(targets(bins.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_repeats))
    if settle:
        found = limits(bins, rates)
    else:
        found = rates.select("source", "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("limit"))
    rows = rows.join(small(cut(found), BROADCAST_SOURCES), F.col("of").eqNullSafe(F.col("source")))
    return rows.select("row", "size", "source_size", "target", (F.col("whole") + (F.col("number") < F.col("limit")).cast("long")).alias("copies"))


def mix(df: DataFrame, weights: tuple[float, ...] | dict[str | None, float] = WEIGHTS, **options) -> DataFrame:
    """The mixed corpus: every row as often as its source's rate and its draw say, with the columns of df. Odd cases: see with_copies()."""
    out = with_copies(df, weights, **options).where("copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).select("row.*")


def op6_bernoulli_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def oracle(weights: tuple[float, ...] = WEIGHTS, most_repeats: float = MOST_REPEATS, seed: str = SEED) -> str:
    drawn = sql_draw(f"'{seed}:' || coalesce(doc_id::VARCHAR, 'null')")
    return f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, floor({drawn} * {BINS})::INTEGER AS bin FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM d GROUP BY source),
    w AS (SELECT *, ([{', '.join(str(float(x)) for x in weights)}])[(rank - 1) % {len(weights)} + 1]::DOUBLE AS weight, source_size::DOUBLE * {float(most_repeats)} AS cap FROM s),
    l AS (SELECT *, cap / weight AS ratio,
          (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
          FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE (SELECT arg_min(level, (ratio, rank)) FROM l WHERE ratio > level) * weight END AS target FROM l),
    r AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole FROM t),
    m AS (SELECT source, bin, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin) - sum(size) / 2.0::DOUBLE AS middle FROM d GROUP BY source, bin),
    k AS (SELECT r.source, r.source_size, r.target, r.whole, coalesce(max(bin + 1) FILTER (middle <= target - whole * source_size AND words > 0 AND target > whole * source_size), 0) AS below
          FROM r JOIN m ON r.source IS NOT DISTINCT FROM m.source GROUP BY ALL)
    SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN bin < below THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source"""
