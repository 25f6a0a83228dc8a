"""Approximate substring counts: how many strings hold a substring within delta edits of each query.

Every strategy returns the same histogram (q, d, n): the number n of strings
at substring edit distance d, for d up to delta. Equal strings are counted
once and weighted, so a database of many repeats costs what its distinct
strings cost. cumulated() turns histograms into the count table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from substrata.functions import text as T
from substrata.plans import kernels

#: Queries go to every task as a block of this many characters at most; more of them are joined ("partition").
MOST_QUERY_CHARS = 8_000_000
#: Within one edit, more queries than so many are looked up in the strings' pieces: a block's work grows with their number.
MOST_BLOCK_QUERIES = 256
GRAM = 2


def collapsed(strings: DataFrame, column: str = "s") -> DataFrame:
    """(s, w): distinct strings and how often they occur; nulls are left out."""
    return weighted(strings, column).groupBy("s").agg(F.sum("w").alias("w"))


def weighted(strings: DataFrame, column: str = "s") -> DataFrame:
    """(s, w): every string with weight 1, without a shuffle; nulls are left out."""
    return strings.select(F.col(column).alias("s"), F.lit(1).cast("long").alias("w")).where("s IS NOT NULL")


def distinct_queries(queries: DataFrame, column: str = "q", prefix_aug: bool = False) -> DataFrame:
    """(q): distinct queries, or the distinct prefixes of all queries."""
    out = queries.select(F.col(column).alias("q")).where("q IS NOT NULL").distinct()
    return out.select(F.explode(T.prefixes("q")).alias("q")).distinct() if prefix_aug else out


def block_of(queries: DataFrame) -> bool:
    """Whether the queries have MOST_QUERY_CHARS characters at most, and so fit a block that every task gets."""
    return (queries.agg(F.sum(F.length("q") + 1)).first()[0] or 0) <= MOST_QUERY_CHARS


def _sent(queries: DataFrame) -> DataFrame:
    """The queries, marked for broadcast if they fit a block."""
    return F.broadcast(queries) if block_of(queries) else queries


def _by_kernel(name: str) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    kernel = kernels.KERNELS[name]

    def strategy(queries: DataFrame, strings: DataFrame, delta: int, spread: bool = True) -> DataFrame:
        if not block_of(queries):
            raise ValueError(f"more than {MOST_QUERY_CHARS} characters of queries; use the strategy 'partition', or blocks of queries")
        names = sorted(r["q"] for r in queries.collect())
        spark = strings.sparkSession
        shared = spark.sparkContext.broadcast(names)
        if spread:  # a kernel's work is queries x characters, of which the size of its input says little: keep every core busy
            strings = strings.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, total = shared.value, np.zeros((len(shared.value), delta + 1), np.int64)
            for batch in batches:
                total += kernel(block, batch.column("s").to_pylist(), batch.column("w").to_numpy(), delta)
            at, d = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([block[k] for k in at], pa.string()), pa.array(d.astype(np.int32)), pa.array(total[at, d])], ["q", "d", "n"])

        return strings.mapInArrow(part, "q string, d int, n bigint").groupBy("q", "d").agg(F.sum("n").alias("n"))

    return strategy


def _counted(pairs: DataFrame, delta: int, banded: bool = False, gram: int | None = None) -> DataFrame:
    """Verify candidate pairs (q, s, w), the cheap test of lengths first. gram: and the bound that missing q-grams set."""
    able = pairs.where(F.length("q") - F.length("s") <= delta)
    if gram:
        able = able.where(T.gram_bound("q", "s", gram) <= delta)
    near = able.withColumn("d", T.sed_within("q", "s", delta, banded)).where(F.col("d") <= delta)
    return near.groupBy("q", "d").agg(F.sum("w").alias("n"))


def _nested(banded: bool) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    return lambda queries, strings, delta: _counted(_sent(queries).crossJoin(strings), delta, banded)


def pigeonhole(queries: DataFrame, delta: int) -> DataFrame:
    """(q, part): delta + 1 parts of each query that is long enough; a string within delta edits holds one unchanged."""
    return queries.where(F.length("q") > delta).select("q", F.explode(T.parts("q", delta + 1)).alias("part"))


def _key() -> list[Column]:
    """Two hashes that stand for a string where its parts or grams are listed: a long string goes through no shuffle once a part."""
    return [F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(1), "s").alias("k2")]


def _with_strings(found: DataFrame, strings: DataFrame) -> DataFrame:
    return found.join(strings.select("s", "w", *_key()), ["k1", "k2"]).select("q", "s", "w")


def partition_candidates(queries: DataFrame, strings: DataFrame, delta: int) -> DataFrame:
    """(q, s, w): pairs in which the string holds one of the query's parts. Short queries pair with every string."""
    cut = pigeonhole(queries, delta)
    sizes = [r[0] for r in cut.select(F.length("part")).distinct().collect()]  # of parts: a handful of numbers
    pieces = F.array_distinct(F.flatten(F.array(*[T.qgrams("s", n) for n in sorted(sizes)]))) if sizes else F.array().cast("array<string>")
    held = strings.select(*_key(), F.explode(pieces).alias("part"))
    found = _with_strings(held.join(cut, "part").select("q", "k1", "k2").distinct(), strings)
    return found.unionByName(_sent(queries.where(F.length("q") <= delta)).crossJoin(strings).select("q", "s", "w"))


def best_grams(costs: Column, n: int, gram: int) -> Column:
    """ARRAY<INT>: the places, from 0, of n disjoint q-grams of the least cost together; of equal ones the first places. costs: of each place.

    Dynamic programming over places: a row has the best choice of 0..n grams
    among the places so far, and a gram goes with the row `gram` places back.
    """
    choice = lambda cost, places: F.struct(cost.cast("double").alias("cost"), places.alias("places"))
    start = F.array(*[choice(F.lit(0.0 if t == 0 else float("inf")), F.array().cast("array<int>")) for t in range(n + 1)])

    def step(rows: Column, at: Column) -> Column:
        last, back = rows[0], rows[gram - 1]
        new = [last[0]] + [F.least(last[t], choice(back[t - 1]["cost"] + costs[at], F.concat(back[t - 1]["places"], F.array(at)))) for t in range(1, n + 1)]
        return F.slice(F.concat(F.array(F.array(*new)), rows), 1, gram)

    return F.aggregate(T.between(F.lit(0), F.size(costs) - 1), F.array(*[start] * gram), step)[0][n]["places"]


def gram_candidates(queries: DataFrame, strings: DataFrame, delta: int, gram: int = GRAM) -> DataFrame:
    """(q, s, w): pairs that share one of delta + 1 disjoint q-grams, those that fewest strings hold."""
    index = strings.select(*_key(), F.explode(F.array_distinct(T.qgrams("s", gram))).alias("gram"))
    frequency = index.groupBy("gram").agg(F.count("*").alias("df"))
    need = (delta + 1) * gram
    places = queries.where(F.length("q") >= need).select("q", F.posexplode(T.qgrams("q", gram)).alias("place", "gram"))
    known = places.join(frequency, "gram", "left").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("grams"))  # as many as the query is long
    chosen = known.select("q", F.explode(F.transform(best_grams(F.col("grams.df"), delta + 1, gram), lambda k: F.col("grams")[k]["gram"])).alias("gram")).distinct()
    found = _with_strings(index.join(chosen, "gram").select("q", "k1", "k2").distinct(), strings)
    return found.unionByName(_sent(queries.where(F.length("q") < need)).crossJoin(strings).select("q", "s", "w"))


STRATEGIES: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {
    "naive": _nested(False),
    "banded": _nested(True),
    "partition": lambda q, s, d: _counted(partition_candidates(q, s, d), d),
    "qgram": lambda q, s, d: _counted(gram_candidates(q, s, d), d, gram=GRAM),
    "interval": _by_kernel("interval"),
    "sorted": _by_kernel("sorted"),
    "sorted_pruned": _by_kernel("sorted_pruned"),
    "trie": _by_kernel("trie"),
    "block": _by_kernel("block"),
    "pieces": _by_kernel("pieces"),
}


def histogram(queries: DataFrame, strings: DataFrame, delta: int, strategy: str = "auto", spread: bool = True) -> DataFrame:
    """(q, d, n) from distinct (q) and weighted (s, w). auto: "block" if the queries fit a block, or "pieces" if they are many and delta is 1 at most, else "partition".

    spread: deal the strings of a kernel strategy out evenly first.
    """
    if strategy == "auto":
        many = delta <= 1 and queries.limit(MOST_BLOCK_QUERIES + 1).count() > MOST_BLOCK_QUERIES
        strategy = "partition" if not block_of(queries) else "pieces" if many else "block"
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join(['auto', *STRATEGIES])}")
    return STRATEGIES[strategy](queries, strings, delta, spread) if strategy in kernels.KERNELS else STRATEGIES[strategy](queries, strings, delta)


def cumulated(queries: DataFrame, counts: DataFrame, delta: int) -> DataFrame:
    """(q, cards ARRAY<BIGINT>): for each query the number of strings within 0..delta, zeros included."""
    within = counts.groupBy("q").agg(*[F.sum(F.when(F.col("d") <= k, F.col("n"))).alias(f"c{k}") for k in range(delta + 1)])
    return queries.join(within, "q", "left").select("q", F.array(*[F.coalesce(f"c{k}", F.lit(0)).cast("long") for k in range(delta + 1)]).alias("cards"))


def approx_substring_count(queries: DataFrame, strings: DataFrame, delta: int, *, strategy: str = "auto", query_col: str = "q", string_col: str = "s", collapse: bool = True, spread: bool = True) -> DataFrame:
    """(word, delta, card): one row for each distinct query and threshold, zeros included.

    collapse: count equal strings once, at the cost of shuffling the distinct
    ones. Without it and without spread a kernel strategy shuffles nothing but
    counts: the plan for a large table of strings that seldom repeat.
    """
    q = distinct_queries(queries, query_col)
    s = (collapsed if collapse or strategy not in ("auto", *kernels.KERNELS) else weighted)(strings, string_col)
    out = cumulated(q, histogram(q, s, delta, strategy, spread), delta)
    return out.select(F.col("q").alias("word"), F.posexplode("cards").alias("delta", "card"))


def prefix_counts(queries: DataFrame, strings: DataFrame, delta: int, *, strategy: str = "auto", query_col: str = "q", string_col: str = "s") -> DataFrame:
    """(word, delta, cards ARRAY<BIGINT>): the counts of all prefixes of each query, shortest first."""
    q = distinct_queries(queries, query_col)
    p = distinct_queries(queries, query_col, prefix_aug=True)
    counted = cumulated(p, histogram(p, collapsed(strings, string_col), delta, strategy), delta)
    spread = q.select(F.col("q").alias("word"), F.explode(T.prefixes("q")).alias("q")).join(counted, "q")
    spread = spread.select("word", F.length("q").alias("k"), F.posexplode("cards").alias("delta", "card"))
    return spread.groupBy("word", "delta").agg(F.sort_array(F.collect_list(F.struct("k", "card"))).alias("c")).select("word", "delta", F.col("c.card").alias("cards"))


def wide(counts: DataFrame, delta: int) -> DataFrame:
    """(word, "0", "1", ...) from (word, delta, card)."""
    out = counts.groupBy("word").pivot("delta", list(range(delta + 1))).agg(F.first("card"))
    return out.select("word", *[F.col(f"`{k}`") for k in range(delta + 1)])


def long(table: DataFrame, delta: int) -> DataFrame:
    """(word, delta, card) from (word, "0", "1", ...)."""
    return table.select("word", F.posexplode(F.array(*[F.col(f"`{k}`") for k in range(delta + 1)])).alias("delta", "card"))


def for_occurrences(queries: DataFrame, counts: DataFrame, query_col: str = "q") -> DataFrame:
    """One row for each occurrence of a query and threshold: repeated queries are kept."""
    return queries.select(F.col(query_col).alias("word")).join(counts, "word")


def labels(queries: DataFrame, counts: DataFrame, prefixes: bool = False) -> DataFrame:
    """The rows of queries (q, ...) with (delta, card) of counts (word, delta, card); a query that isn't there is an error.

    prefixes: a row for each prefix, q, of length k, in place of the query's.
    """
    rows = queries
    if prefixes:
        others = [F.col(f"`{c}`") for c in queries.columns if c != "q"]
        rows = queries.select(*others, F.posexplode(T.prefixes("q")).alias("k", "q")).withColumn("k", F.col("k") + 1)
    found = rows.join(counts.withColumnRenamed("word", "q"), "q", "left")
    return found.withColumn("delta", F.coalesce("delta", F.raise_error(F.concat(F.lit("no count of "), F.col("q"))).cast("int")))


def packed(counts: DataFrame) -> DataFrame:
    """(word, cards ARRAY<STRUCT<delta, card>>) from (word, delta, card)."""
    return counts.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("delta", "card"))).alias("cards"))


def unpacked(rows: DataFrame) -> DataFrame:
    """A row for each entry of cards, beside the other columns."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "cards"], F.inline("cards"))


def steps(counts: DataFrame) -> DataFrame:
    """Add to (word, delta, card) the step from the threshold before, and so_far, the sum of cards up to it."""
    order = Window.partitionBy("word").orderBy("delta")
    so_far = F.sum("card").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumns({"step": F.col("card") - F.coalesce(F.lag("card").over(order), F.lit(0)), "so_far": so_far})


def running(counts: DataFrame) -> DataFrame:
    """(q, d, n) -> (q, d, n, card), card the sum up to d."""
    return counts.withColumn("card", F.sum("n").over(Window.partitionBy("q").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)))


def work(queries: DataFrame, strings: DataFrame) -> DataFrame:
    """One row: distance-table lines and cells of a nested loop, and those left if queries share the lines of their prefixes."""
    q, s = distinct_queries(queries), collapsed(strings)
    sizes = q.agg(F.count("*").alias("n_qry"), F.coalesce(F.sum(F.length("q")), F.lit(0)).cast("long").alias("q_len"))
    prefix = distinct_queries(queries, prefix_aug=True).agg(F.count("*").alias("n_prfx"))
    rows = s.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n_rec"), F.coalesce(F.sum(F.length("s") * F.col("w")), F.lit(0)).alias("s_len"))
    n = F.col("n_rec")
    return sizes.crossJoin(prefix).crossJoin(rows).select(
        "n_qry", "n_prfx", "n_rec", (F.col("q_len") * n).alias("total_line"), (F.col("n_prfx") * n).alias("shared_line"),
        (F.col("q_len") * F.col("s_len")).alias("total_cell"), (F.col("n_prfx") * F.col("s_len")).alias("shared_cell"), (F.col("n_qry") * n).alias("all_pairs"),
    )


def measured(queries: DataFrame, strings: DataFrame, delta: int) -> DataFrame:
    """(strategy, total and computed and pruned lines and cells) of the strategies that share prefixes, as their kernels count them.

    total: of a nested loop. pruned: of the lines that sharing leaves, those that were skipped.
    """
    q, s = distinct_queries(queries), collapsed(strings)
    if not block_of(q):
        raise ValueError(f"more than {MOST_QUERY_CHARS} characters of queries")
    shared = strings.sparkSession.sparkContext.broadcast(sorted(r["q"] for r in q.collect()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {name: np.zeros(2, np.int64) for name in ("sorted", "sorted_pruned", "trie")}
        for batch in batches:
            rows = shared.value, batch.column("s").to_pylist(), batch.column("w").to_numpy(), delta
            kernels.shared_prefix(*rows, prune=False, work=found["sorted"])
            kernels.shared_prefix(*rows, work=found["sorted_pruned"])
            kernels.live_cells(*rows, work=found["trie"])
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), *(pa.array([x[k] for x in found.values()], pa.int64()) for k in (0, 1))], ["strategy", "line", "cell"])

    sums = s.mapInArrow(part, "strategy string, line bigint, cell bigint").groupBy("strategy").agg(F.sum("line").alias("computed_line"), F.sum("cell").alias("computed_cell"))
    whole = work(queries, strings)
    out = sums.crossJoin(F.broadcast(whole))
    return out.select("strategy", "total_line", "computed_line", (F.col("shared_line") - F.col("computed_line")).alias("pruned_line"), "total_cell", "computed_cell", (F.col("shared_cell") - F.col("computed_cell")).alias("pruned_cell"))


def filtered_pairs(queries: DataFrame, strings: DataFrame, delta: int) -> DataFrame:
    """(filter, pairs, distinct_pairs): what each filter leaves to verify, in rows and in distinct strings."""
    q, s = distinct_queries(queries), collapsed(strings)
    made = [make(q, s, delta).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("pairs"), F.count("*").alias("distinct_pairs")).select(F.lit(name).alias("filter"), "pairs", "distinct_pairs") for name, make in (("partition", partition_candidates), ("qgram", gram_candidates))]
    return made[0].unionByName(made[1])


def violations(counts: DataFrame, n: int) -> DataFrame:
    """Rows of (word, delta, card) that no true count table has, with the reason.

    A count is between 0 and n, doesn't fall with the threshold, is n once the
    threshold reaches the query's length, and doesn't grow as a query that the
    table has too is continued.
    """
    order = Window.partitionBy("word").orderBy("delta")
    rows = counts.withColumn("before", F.lag("card").over(order))
    shorter = counts.select(F.col("word").alias("start"), "delta", F.col("card").alias("wider"))
    rows = rows.withColumn("start", F.expr("substring(word, 1, length(word) - 1)")).join(shorter, ["start", "delta"], "left")
    reason = (
        F.when((F.col("card") < 0) | (F.col("card") > n), "out of range")
        .when(F.col("card") < F.col("before"), "falls with the threshold")
        .when((F.col("delta") >= F.length("word")) & (F.col("card") != n), "not all strings at its own length")
        .when(F.col("card") > F.col("wider"), "more than its prefix")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("word", "delta", "card", "reason")
