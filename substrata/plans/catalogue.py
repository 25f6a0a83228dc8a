"""The engine's queries over the test tables, each beside the SQL that says the same.

Strings are part names unless a query says otherwise: few distinct ones, with
many repeats, over all rows of the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from substrata.functions import stats as S
from substrata.functions import text as T
from substrata.operators import count, encode, index, lbs, metrics, models, runs, sampling, summary
from substrata.streaming import counts as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DELTA = 2
COEFFICIENTS = S.hash_coefficients(10)
STRATEGIES = ("naive", "banded", "partition", "qgram", "interval", "sorted", "sorted_pruned", "trie", "block")
_WILD = "chr(57344)"


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_name").alias("s"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_name").alias("q")).distinct()


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("rid"), F.col("p_name").alias("s"))


def _long(c: Column) -> Column:
    return c.cast("long")


# --- counting -------------------------------------------------------------------------------------


def _sql_counts(q: str, s: str, delta: int) -> str:
    """CTEs q, s, h (q, d, n) and c (word, delta, card), from queries for (q) and for (s, w)."""
    return f"""q AS ({q}), s AS ({s}),
    h AS (SELECT q, d, sum(w)::BIGINT AS n FROM (
        SELECT q, s, w, least(length(q), min(levenshtein(q, substr(s, pos, len)))) AS d FROM (
            SELECT q, s, w, len, unnest(range(1, greatest(length(s) - len + 1, 1) + 1)) AS pos FROM (
                SELECT q, s, w, unnest(range(greatest(length(q) - {delta}, 1), length(q) + {delta} + 1)) AS len FROM q, s))
        GROUP BY q, s, w) WHERE d <= {delta} GROUP BY q, d),
    g AS (SELECT q, unnest(range(0, {delta + 1})) AS delta FROM q),
    c AS (SELECT g.q AS word, g.delta::INTEGER AS delta, coalesce(sum(h.n), 0)::BIGINT AS card FROM g LEFT JOIN h ON h.q = g.q AND h.d <= g.delta GROUP BY 1, 2)"""


_PART = _sql_counts("SELECT DISTINCT p_name AS q FROM part", "SELECT p_name AS s, count(*) AS w FROM part GROUP BY 1", DELTA)


@query("WITH q AS (SELECT DISTINCT p_name AS q FROM part), s AS (SELECT p_name AS s, count(*) AS w FROM part GROUP BY 1) SELECT q AS word, sum(CASE WHEN contains(s, q) THEN w ELSE 0 END)::BIGINT AS card FROM q, s GROUP BY 1")
def substring_count_delta0(spark: SparkSession, d: str) -> DataFrame:
    return count.approx_substring_count(_queries(spark, d), _names(spark, d), 0).select("word", "card")


def _strategy(name: str) -> Query:
    return lambda spark, d: count.approx_substring_count(_queries(spark, d), _names(spark, d), DELTA, strategy=name)


for _name in STRATEGIES:
    query(f"WITH {_PART} SELECT word, delta, card FROM c", f"approx_count_{_name}_part")(_strategy(_name))

_PRIORITY = _sql_counts("SELECT DISTINCT substr(o_orderpriority, 3) AS q FROM orders", "SELECT o_orderpriority AS s, count(*) AS w FROM orders GROUP BY 1", 3)


@query(f"WITH {_PRIORITY} SELECT word, delta, card FROM c")
def approx_count_repeated_strings(spark: SparkSession, d: str) -> DataFrame:
    """Five distinct strings in all orders: the weights do the counting."""
    orders = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("s"))
    return count.approx_substring_count(orders.select(F.expr("substring(s, 3)").alias("q")), orders, 3)


_CUSTOMER = _sql_counts("SELECT DISTINCT c_mktsegment AS q FROM customer", "SELECT p_type || ' ' || c_mktsegment AS s, count(*) AS w FROM part JOIN customer ON p_partkey = c_custkey GROUP BY 1", 1)


@query(f"WITH {_CUSTOMER} SELECT word, delta, card FROM c")
def approx_count_joined_strings(spark: SparkSession, d: str) -> DataFrame:
    """Over strings that a join makes."""
    customer, part = _t(spark, d, "customer"), _t(spark, d, "part")
    strings = part.join(customer, F.col("p_partkey") == F.col("c_custkey")).select(F.concat_ws(" ", "p_type", "c_mktsegment").alias("s"))
    return count.approx_substring_count(customer.select(F.col("c_mktsegment").alias("q")), strings, 1)


@query()
def approx_count_block_docs(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark words over every line of every document, whole."""
    words = _t(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("q")).where(F.length("q") > 0)
    lines = _t(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("s"))
    return count.approx_substring_count(words, lines, 1)


_PREFIXED = _sql_counts(
    "SELECT DISTINCT substr(p_name, 1, k) AS q FROM (SELECT p_name, unnest(range(1, length(p_name) + 1)) AS k FROM part)", "SELECT p_name AS s, count(*) AS w FROM part GROUP BY 1", 1
)


@query(f"""WITH {_PREFIXED}, w AS (SELECT DISTINCT p_name AS word FROM part), p AS (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w)
    SELECT p.word, c.delta, string_agg(c.card::VARCHAR, ':' ORDER BY p.k) AS cards FROM p JOIN c ON c.word = substr(p.word, 1, p.k) GROUP BY 1, 2""")
def approx_count_prefix_aug(spark: SparkSession, d: str) -> DataFrame:
    out = count.prefix_counts(_queries(spark, d), _names(spark, d), 1)
    return out.select("word", "delta", F.array_join(F.col("cards").cast("array<string>"), ":").alias("cards"))


@query(f'WITH {_PART} SELECT word, max(card) FILTER (delta = 0) AS "0", max(card) FILTER (delta = 1) AS "1", max(card) FILTER (delta = 2) AS "2" FROM c GROUP BY 1')
def count_table_wide(spark: SparkSession, d: str) -> DataFrame:
    return count.wide(count.approx_substring_count(_queries(spark, d), _names(spark, d), DELTA), DELTA)


@query(f"WITH {_PART} SELECT word, delta, card FROM c")
def count_table_wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    return count.long(count_table_wide(spark, d), DELTA)


@query(f"WITH {_PART} SELECT q, d::INTEGER AS d, n, sum(n) OVER (PARTITION BY q ORDER BY d)::BIGINT AS card FROM h")
def cumulative_histogram(spark: SparkSession, d: str) -> DataFrame:
    q = count.distinct_queries(_queries(spark, d))
    return count.running(count.histogram(q, count.collapsed(_names(spark, d)), DELTA))


@query(f"WITH {_PART} SELECT p_partkey AS qid, word, delta, card FROM part JOIN c ON word = p_name")
def count_per_query_occurrence(spark: SparkSession, d: str) -> DataFrame:
    counts = count.approx_substring_count(_queries(spark, d), _names(spark, d), DELTA)
    return _t(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("word")).join(F.broadcast(counts), "word").select("qid", "word", "delta", "card")


_FILTERS = """q AS (SELECT DISTINCT p_name AS q FROM part), s AS (SELECT p_name AS s, count(*) AS w FROM part GROUP BY 1),
    p AS (SELECT q, k, substr(q, k * (length(q) // 3) + least(k, length(q) % 3) + 1, length(q) // 3 + CASE WHEN k < length(q) % 3 THEN 1 ELSE 0 END) AS part FROM (SELECT q, unnest(range(0, 3)) AS k FROM q))"""


#: Three disjoint 2-grams of each query that fewest strings hold.
_BEST_GRAMS = """r AS (SELECT q, spot, substr(q, spot::INTEGER, 2) AS gram FROM (SELECT q, unnest(range(1, length(q))) AS spot FROM q WHERE length(q) >= 6)),
    f AS (SELECT gram, count(*) AS df FROM (SELECT DISTINCT gram FROM r) JOIN s ON contains(s, gram) GROUP BY 1),
    x AS (SELECT r.*, coalesce(df, 0) AS df FROM r LEFT JOIN f ON r.gram = f.gram),
    b AS (SELECT q, unnest(min({'cost': i.df + j.df + k.df, 'a': i.spot, 'b': j.spot, 'c': k.spot})) FROM x i JOIN x j USING (q) JOIN x k USING (q) WHERE i.spot + 2 <= j.spot AND j.spot + 2 <= k.spot GROUP BY q)"""


@query(f"WITH {_FILTERS}, {_BEST_GRAMS} SELECT b.q, string_agg(x.gram, ' ' ORDER BY x.spot) AS grams, any_value(cost)::BIGINT AS cost FROM b JOIN x ON x.q = b.q AND x.spot IN (b.a, b.b, b.c) GROUP BY 1")
def best_disjoint_grams(spark: SparkSession, d: str) -> DataFrame:
    grams = _queries(spark, d).where("length(q) >= 6").select("q", F.posexplode(T.qgrams("q", 2)).alias("place", "gram"))
    df = count.collapsed(_names(spark, d)).select(F.explode(F.array_distinct(T.qgrams("s", 2))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    rows = grams.join(df, "gram").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "df", "gram"))).alias("g")).withColumn("best", count.best_grams(F.col("g.df"), DELTA + 1, 2))
    chosen = F.transform("best", lambda k: F.col("g")[k])
    return rows.select("q", F.array_join(chosen["gram"], " ").alias("grams"), F.aggregate(chosen["df"], F.lit(0).cast("long"), lambda a, x: a + x).alias("cost"))


@query(f"WITH {_FILTERS} SELECT q, s, sum(CASE WHEN contains(s, substr(q, (2 * k + 1)::INTEGER, 2)) THEN 0 ELSE 1 END)::INTEGER AS bound FROM (SELECT q, unnest(range(0, length(q) // 2)) AS k FROM q), s GROUP BY 1, 2")
def gram_lower_bounds(spark: SparkSession, d: str) -> DataFrame:
    """What the 2-grams that a string lacks say of its distance, before any is computed."""
    q, s = _queries(spark, d), count.collapsed(_names(spark, d)).select("s")
    return F.broadcast(q).crossJoin(s).select("q", "s", T.gram_bound("q", "s", 2).alias("bound"))


@query(f"WITH {_FILTERS} SELECT q, k::INTEGER AS k, part FROM p")
def pigeonhole_parts(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("q", F.posexplode(T.parts("q", DELTA + 1)).alias("k", "part"))


@query(f"WITH {_FILTERS} SELECT q, s, any_value(w)::BIGINT AS w FROM p, s WHERE contains(s, part) GROUP BY 1, 2")
def pigeonhole_candidates(spark: SparkSession, d: str) -> DataFrame:
    return count.partition_candidates(_queries(spark, d), count.collapsed(_names(spark, d)), DELTA)


@query("""WITH q AS (SELECT DISTINCT p_name AS q FROM part), p AS (SELECT DISTINCT substr(q, 1, k::INTEGER) AS p FROM (SELECT q, unnest(range(1, length(q) + 1)) AS k FROM q)),
    a AS (SELECT count(*) AS n_qry, sum(length(q))::BIGINT AS q_len FROM q), b AS (SELECT count(*) AS n_prfx FROM p), c AS (SELECT count(*) AS n_rec, sum(length(p_name))::BIGINT AS s_len FROM part)
    SELECT n_qry, n_prfx, n_rec, q_len * n_rec AS total_line, n_prfx * n_rec AS shared_line, q_len * s_len AS total_cell, n_prfx * s_len AS shared_cell, n_qry * n_rec AS all_pairs FROM a, b, c""")
def work_statistics(spark: SparkSession, d: str) -> DataFrame:
    return count.work(_queries(spark, d), _names(spark, d))


@query(f"""WITH {_FILTERS}, {_BEST_GRAMS},
    c AS (SELECT DISTINCT 'partition' AS filter, q, s, w FROM p, s WHERE contains(s, part) UNION ALL (SELECT DISTINCT 'qgram', r.q, s, w FROM r JOIN b ON r.q = b.q AND r.spot IN (b.a, b.b, b.c) JOIN s ON contains(s, gram)) UNION ALL SELECT 'qgram', q, s, w FROM q, s WHERE length(q) < 6)
    SELECT filter, sum(w)::BIGINT AS pairs, count(*) AS distinct_pairs FROM c GROUP BY 1""")
def filter_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a query and a row that each filter leaves to verify."""
    return count.filtered_pairs(_queries(spark, d), _names(spark, d), DELTA)


@query(f"WITH {_PART} SELECT q, d::INTEGER AS d, n FROM h")
def streaming_counts(spark: SparkSession, d: str) -> DataFrame:
    """The histogram over part names that arrive as a stream."""
    names = [r["q"] for r in _queries(spark, d).collect()]
    stream = streaming.open_parquet(spark, f"{d}/part*.parquet", "p_partkey bigint, p_name string").withColumnRenamed("p_name", "s")
    return streaming.run_to_end(streaming.streaming_histogram(stream, names, DELTA), "substrata_counts")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_event_windows(spark: SparkSession, d: str) -> DataFrame:
    stream = streaming.open_parquet(spark, f"{d}/events*.parquet", "event_id bigint, ts timestamp, event_type string")
    return streaming.run_to_end(streaming.event_windows(stream), "substrata_windows")


# --- strings --------------------------------------------------------------------------------------


def _spread(kind: str, expression: str, ranges: str) -> str:
    return f"SELECT string, count(*) AS frequency FROM (SELECT {expression} AS string FROM (SELECT p_name AS s, {ranges} FROM part)) GROUP BY 1"


@query("SELECT prefix, count(DISTINCT p_name) AS n FROM (SELECT p_name, substr(p_name, 1, unnest(range(1, length(p_name) + 1))::INTEGER) AS prefix FROM part) GROUP BY 1")
def distinct_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select(F.explode(T.prefixes("q")).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


@query("SELECT string, count(*) AS frequency FROM (SELECT substr(p_name, unnest(range(1, length(p_name) + 1))::INTEGER) AS string FROM part) GROUP BY 1")
def all_suffix_freq(spark: SparkSession, d: str) -> DataFrame:
    return summary.generated(_names(spark, d), T.suffixes)


@query("""SELECT string, count(*) AS frequency FROM (SELECT substr(s, i::INTEGER, unnest(range(1, length(s) - i + 2))::INTEGER) AS string
    FROM (SELECT p_name AS s, unnest(range(1, length(p_name) + 1)) AS i FROM part)) GROUP BY 1""")
def all_substring_freq(spark: SparkSession, d: str) -> DataFrame:
    return summary.generated(_names(spark, d), lambda s: T.substrings(s, 1, F.length(s)))


@query("SELECT string, count(*) AS selectivity FROM (SELECT substr(p_name, 1, unnest(range(1, least(length(p_name), 20) + 1))::INTEGER) AS string FROM part) GROUP BY 1")
def prefix_selectivity(spark: SparkSession, d: str) -> DataFrame:
    return summary.selectivities(summary.tree(_names(spark, d)))


_GRAMS = "g AS (SELECT p_partkey AS rid, i - 1 AS pos, substr(p_name, i::INTEGER, 2) AS token FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name))) AS i FROM part))"


@query(f"WITH {_GRAMS} SELECT token, part, sum(count(*)) OVER (PARTITION BY token)::BIGINT AS df, string_agg(rid::VARCHAR, ',' ORDER BY rid) AS rids FROM (SELECT DISTINCT rid, token, rid // 500 AS part FROM g) GROUP BY 1, 2")
def qgram_postings(spark: SparkSession, d: str) -> DataFrame:
    out = index.postings(_rows(spark, d), T.qgrams("s", 2), span=500)
    return out.select("token", "part", "df", F.array_join(F.col("rids").cast("array<string>"), ",").alias("rids"))


@query(f"WITH {_GRAMS} SELECT token, count(*) AS df FROM (SELECT DISTINCT rid, token FROM g) GROUP BY 1 ORDER BY df DESC, token LIMIT 20")
def qgram_df_topk(spark: SparkSession, d: str) -> DataFrame:
    return index.top_tokens(_rows(spark, d).select("rid", F.explode(F.array_distinct(T.qgrams("s", 2))).alias("token")), 20)


@query(f"WITH {_GRAMS} SELECT rid, pos::INTEGER AS pos, token AS gram FROM g")
def positional_qgrams(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("rid", F.inline(T.positional_qgrams("s", 2)))


@query("""WITH q AS (SELECT DISTINCT p_name AS q FROM part), l AS (SELECT q, lag(q) OVER (ORDER BY q) AS p FROM q)
    SELECT q, coalesce(list_aggregate(list_transform(range(1, least(length(q), length(p)) + 1), lambda i: CASE WHEN substr(q, 1, i::INTEGER) = substr(p, 1, i::INTEGER) THEN 1 ELSE 0 END), 'sum'), 0)::INTEGER AS lcp FROM l""")
def lcp_sorted(spark: SparkSession, d: str) -> DataFrame:
    """How much of the distance table a query shares with the one before it."""
    q = sampling.in_sequence(_queries(spark, d), ["q"], "place")
    before = q.select(F.col("q").alias("p"), (F.col("place") + 1).alias("place"))
    return q.join(before, "place", "left").select("q", T.common_prefix("q", "p").alias("lcp"))


_CHARS = "c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS ch FROM part) GROUP BY 1), dict AS (SELECT ch, n, (row_number() OVER (ORDER BY n DESC, ch) + 1)::INTEGER AS id FROM c)"
_CODED = f"WITH {_CHARS}, q AS (SELECT DISTINCT p_name AS q FROM part), x AS (SELECT q, k, coalesce(CASE WHEN id < 14 THEN id END, 1) AS id FROM (SELECT q, generate_subscripts(string_split(q, ''), 1) AS k, unnest(string_split(q, '')) AS ch FROM q) LEFT JOIN dict USING (ch)), e AS (SELECT q, list(id ORDER BY k) AS ids FROM x GROUP BY q)"


@query(f"WITH {_CHARS} SELECT ch, n, id FROM dict")
def char_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return encode.char_dictionary(_names(spark, d))


@query("SELECT ch, (row_number() OVER (ORDER BY ch) - 1)::INTEGER AS id FROM (SELECT DISTINCT unnest(string_split(p_name, '')) AS ch FROM part)")
def sorted_alphabet(spark: SparkSession, d: str) -> DataFrame:
    return encode.alphabet(_names(spark, d))


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    codes = encode.lookup(encode.char_dictionary(_names(spark, d), 12))
    return _queries(spark, d).select("q", encode.encoded("q", codes).alias("ids"))


@query(f"{_CODED} SELECT q, array_to_string(ids, ',') AS ids FROM e")
def encoded_queries(spark: SparkSession, d: str) -> DataFrame:
    """The 12 most frequent characters by number, 1 for the others."""
    return _encoded(spark, d).select("q", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"{_CODED} SELECT q, array_to_string(list_concat(ids, list_transform(range(10), lambda i: 0))[1:10], ',') AS ids, array_to_string(list_concat(list_transform(range(10), lambda i: 0), ids)[-10:], ',') AS ids_pre FROM e")
def padded_sequences(spark: SparkSession, d: str) -> DataFrame:
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return _encoded(spark, d).select("q", text(T.padded("ids", 10)).alias("ids"), text(T.padded("ids", 10, post=False)).alias("ids_pre"))


@query(f"{_CODED} SELECT id::INTEGER AS id, count(*) AS n FROM (SELECT unnest(ids[1:8]) AS id FROM e) GROUP BY 1")
def packed_sequence_counts(spark: SparkSession, d: str) -> DataFrame:
    sequences = _encoded(spark, d).withColumn("length", F.least(F.size("ids"), F.lit(8)))
    return encode.packed(sequences, "ids", "length", ["q"]).groupBy("id").agg(F.count("*").alias("n"))


@query(f"{_CODED} SELECT q, list_aggregate(list_transform(ids, lambda x: list_aggregate(list_transform(range(14), lambda j: CASE WHEN x = j THEN j ELSE 0 END), 'sum')), 'sum')::BIGINT AS checksum FROM e")
def one_hot_checksum(spark: SparkSession, d: str) -> DataFrame:
    rows = _encoded(spark, d).select("q", T.one_hot("ids", 14).alias("m"))
    weighed = F.aggregate("m", F.lit(0).cast("long"), lambda a, row: a + F.aggregate(F.transform(row, lambda x, j: x * j), F.lit(0).cast("long"), lambda b, x: b + x))
    return rows.select("q", weighed.alias("checksum"))


@query(f"{_CODED} SELECT q, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS bits FROM (SELECT DISTINCT q, unnest(range(id * 14 + k - 1, id * 14 + k + 2)) AS bit FROM x) GROUP BY q")
def shifted_bits(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).select("q", F.array_join(T.bit_positions("ids", 12, 1).cast("array<string>"), ",").alias("bits"))


_NAMED = "SELECT p_partkey AS rid, p_name AS s FROM part"
_WILDCARDS = f"""p AS (SELECT DISTINCT rid, substr(s, i::INTEGER, len::INTEGER) AS piece FROM (SELECT rid, s, len, unnest(range(1, length(s) - len + 2)) AS i FROM (SELECT rid, s, unnest(range(1, 4)) AS len FROM ({_NAMED}))) WHERE i + len <= length(s) + 1),
    k AS (SELECT DISTINCT rid, array_to_string(list_transform(range(1, length(piece) + 1), lambda i: CASE WHEN (m >> (i - 1)::INTEGER) & 1 = 1 THEN {_WILD} ELSE substr(piece, i::INTEGER, 1) END), '') AS token
          FROM (SELECT rid, piece, unnest(range(0, (1 << length(piece))::BIGINT)) AS m FROM p))"""


@query(f"WITH {_WILDCARDS} SELECT token, count(*) AS cnt FROM k GROUP BY 1")
def eqt_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.extended_table(_rows(spark, d), 3)


@query(f"WITH {_WILDCARDS} SELECT token, count(*) AS cnt FROM k GROUP BY 1 HAVING count(*) >= 20")
def eqt_pruned(spark: SparkSession, d: str) -> DataFrame:
    return index.extended_table(_rows(spark, d), 3, 20)


@query(f"WITH {_WILDCARDS} SELECT rid, count(*) AS n, count(*) FILTER (contains(token, {_WILD})) AS n_wild FROM k GROUP BY 1")
def wildcard_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return index.wildcard_ngrams(_rows(spark, d), 3).groupBy("rid").agg(F.count("*").alias("n"), F.sum(F.contains("token", F.lit(T.WILDCARD)).cast("long")).alias("n_wild"))


@query("""WITH q AS (SELECT DISTINCT p_name AS q FROM part), s AS (SELECT p_name AS s, count(*) AS w FROM part GROUP BY 1)
    SELECT q, sum(CASE WHEN s LIKE '%' || substr(q, 1, 1) || '_' || substr(q, 3) || '%' THEN w ELSE 0 END)::BIGINT AS n FROM q, s GROUP BY 1""")
def wildcard_match(spark: SparkSession, d: str) -> DataFrame:
    """Strings that hold the query with any second character."""
    q = _queries(spark, d).withColumn("pattern", F.concat(F.substring("q", 1, 1), F.lit(T.WILDCARD), F.expr("substring(q, 3)")))
    found = F.broadcast(q).crossJoin(count.collapsed(_names(spark, d)))
    return found.groupBy("q").agg(F.sum(F.when(T.contains_pattern("s", "pattern"), F.col("w")).otherwise(0)).alias("n"))


@query("SELECT s_name, contains(s_name, ',') AS comma, strlen(s_name) = length(s_name) AS is_ascii, substr(s_name, 1, 8) AS head, substr(s_name, 9, 3) AS middle, array_to_string(list_transform(string_split(s_name, ''), lambda x: ord(x)), ' ') AS points, CASE WHEN s_name = s_name THEN '\"a,' || s_name || '\"' END AS token FROM supplier")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    cut = T.fixed_width("s_name", [8, 3])
    return s.select("s_name", F.contains("s_name", F.lit(",")).alias("comma"), T.is_ascii("s_name").alias("is_ascii"), cut[0].alias("head"), cut[1].alias("middle"), F.array_join(T.code_points("s_name").cast("array<string>"), " ").alias("points"), T.csv_token(F.concat(F.lit("a,"), "s_name")).alias("token"))


@query("SELECT page_id, CASE WHEN contains(string_split(url, '/')[-1], '.') THEN regexp_extract(string_split(url, '/')[-1], '\\.([^.]*)$', 1) ELSE '' END AS extension, string_split(url, '/')[-1] AS basename FROM pages")
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", T.extension("url").alias("extension"), T.basename("url").alias("basename"))


# --- MinHash and LBS ------------------------------------------------------------------------------

_HASHED = ", ".join(f"min((rid * {a} + {b}) % {S.PRIME}) AS h{k}" for k, (a, b) in enumerate(COEFFICIENTS))
_SIGNED = f"{_GRAMS}, sig AS (SELECT token, count(*) AS cnt, {_HASHED} FROM (SELECT DISTINCT rid, token FROM g) GROUP BY 1)"
_SIG_LIST = ", ".join(f"h{k}" for k in range(10))


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    return index.signatures(_rows(spark, d).select("rid", F.explode(F.array_distinct(T.qgrams("s", 2))).alias("token")), COEFFICIENTS)


@query(f"SELECT p_partkey AS rid, {', '.join(f'(row_number() OVER (ORDER BY (p_partkey * {a} + {b}) % {S.PRIME}) - 1)::INTEGER AS r{k}' for k, (a, b) in enumerate(COEFFICIENTS[:3]))} FROM part")
def minhash_ranks(spark: SparkSession, d: str) -> DataFrame:
    return index.ranks(_rows(spark, d), COEFFICIENTS[:3])


@query(f"WITH {_SIGNED} SELECT token, cnt, array_to_string([{_SIG_LIST}], ',') AS sig FROM sig")
def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _signatures(spark, d).select("token", "cnt", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of the 2-grams that start with one letter, side by side."""
    x = _signatures(spark, d).withColumn("lead", F.substring("token", 1, 1))
    y = x.select("lead", F.col("token").alias("other"), F.col("cnt").alias("cnt2"), F.col("sig").alias("sig2"))
    return x.join(y, "lead").where("token < other")


_SHARE = "(" + " + ".join(f"(a.h{k} = b.h{k})::INTEGER" for k in range(10)) + ") / 10.0::DOUBLE"
_SIDES = "FROM sig a JOIN sig b ON substr(a.token, 1, 1) = substr(b.token, 1, 1) AND a.token < b.token"


@query(f"WITH {_SIGNED} SELECT a.token, b.token AS other, {_SHARE} AS jaccard {_SIDES}")
def jaccard_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("token", "other", S.equal_share("sig", "sig2").alias("jaccard"))


@query(f"""WITH {_SIGNED} SELECT a.token, b.token AS other, round((a.cnt + b.cnt) / (1 + {_SHARE}), 6) AS n_union,
    array_to_string([{', '.join(f'least(a.h{k}, b.h{k})' for k in range(10))}], ',') AS u, array_to_string([{', '.join(f'greatest(a.h{k}, b.h{k})' for k in range(10))}], ',') AS i {_SIDES}""")
def union_estimate(spark: SparkSession, d: str) -> DataFrame:
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    p = _pairs(spark, d)
    return p.select("token", "other", F.round(S.union_size("cnt", "cnt2", S.equal_share("sig", "sig2")), 6).alias("n_union"), text(S.signature_union("sig", "sig2")).alias("u"), text(S.signature_intersection("sig", "sig2")).alias("i"))


def _grid(spark: SparkSession, d: str, delta: int = 1) -> DataFrame:
    return _queries(spark, d).select("q", F.explode(F.sequence(F.lit(0), F.lit(delta))).alias("delta"))


@query()
def lbs_patterns(spark: SparkSession, d: str) -> DataFrame:
    return lbs.patterns(_grid(spark, d, 2))


@query()
def lbs_estimate(spark: SparkSession, d: str) -> DataFrame:
    return lbs.estimate(_grid(spark, d), lbs.build(_rows(spark, d), n=4, least=1), n=4)


@query()
def lbs_report(spark: SparkSession, d: str) -> DataFrame:
    """LBS against the truth, its coverage taken from a sample of it."""
    truth = count.approx_substring_count(_queries(spark, d), _names(spark, d), 1).withColumnRenamed("word", "q")
    table = lbs.build(_rows(spark, d), n=4, least=1).cache()
    found = lbs.estimate(truth.select("q", "delta"), table, lbs.coverage(truth, table, n=4), n=4)
    return metrics.crosstab(metrics.with_errors(truth.join(found, ["q", "delta"]).withColumn("len", F.length("q"))))


# --- errors ---------------------------------------------------------------------------------------

_ESTIMATED = f"{_PART}, e AS (SELECT word, delta, card, length(word)::INTEGER AS len, (SELECT count(*) FROM part) * (delta + 1) / (10.0::DOUBLE * length(word)) AS estimate FROM c)"
_Q = "greatest(greatest(card, 1) / greatest(estimate, 1.0::DOUBLE), greatest(estimate, 1.0::DOUBLE) / greatest(card, 1))"
_QE = "greatest((card + 10.0::DOUBLE) / (greatest(estimate, 0) + 10.0::DOUBLE), (greatest(estimate, 0) + 10.0::DOUBLE) / (card + 10.0::DOUBLE))"


def _estimated(spark: SparkSession, d: str) -> DataFrame:
    """True counts beside a crude guess: the shorter the query, the more strings."""
    n = _t(spark, d, "part").count()
    counts = count.approx_substring_count(_queries(spark, d), _names(spark, d), DELTA).withColumn("len", F.length("word"))
    return metrics.with_errors(counts.withColumn("estimate", F.lit(n) * (F.col("delta") + 1) / (F.lit(10.0) * F.col("len"))))


@query(f"WITH {_ESTIMATED}, x AS (SELECT {_Q} AS q FROM e) SELECT count(*) AS n, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS std, round(min(q), 6) AS least, round(max(q), 6) AS most FROM x")
def qerror_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(_estimated(spark, d)).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most")])


@query(f"WITH {_ESTIMATED} SELECT word, delta, round({_QE}, 9) AS q_err_eps, round(log10(greatest(estimate, 1.0::DOUBLE) / greatest(card, 1)), 9) AS log10_err, round(pow(ln(1 + estimate) - ln(1 + card), 2), 9) AS msle FROM e")
def qerror_eps_and_log(spark: SparkSession, d: str) -> DataFrame:
    return _estimated(spark, d).select("word", "delta", *[F.round(c, 9).alias(c) for c in ("q_err_eps", "log10_err", "msle")])


@query(f"WITH {_ESTIMATED}, x AS (SELECT {_Q} AS q FROM e), l AS (SELECT unnest({list(metrics.LEVELS)}) AS level), v AS (SELECT quantile_cont(q, {list(metrics.LEVELS)}) AS v FROM x) SELECT unnest({list(metrics.LEVELS)})::DOUBLE AS level, round(unnest(v), 6) AS value FROM v")
def qerror_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.quantiles(_estimated(spark, d)).select("level", F.round("value", 6).alias("value"))


@query(f"WITH {_ESTIMATED} SELECT delta, len, count(*) AS n, round(avg({_Q}), 6) AS q_err, round(avg({_QE}), 6) AS q_err_eps FROM e GROUP BY CUBE (delta, len)")
def qerror_cube(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.crosstab(_estimated(spark, d))
    return out.select("delta", "len", "n", F.round("q_err", 6).alias("q_err"), F.round("q_err_eps", 6).alias("q_err_eps"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS price FROM lineitem GROUP BY 1, 2")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(metrics.weighted_mean(None, "l_extendedprice", "l_quantity"), 4).alias("price"))


@query("""WITH s AS (SELECT min(ln(greatest(1, o_totalprice))) AS lo, max(ln(greatest(1, o_totalprice))) AS hi FROM orders), x AS (SELECT o_orderkey, o_totalprice, least(greatest((ln(greatest(1, o_totalprice)) - lo) / (hi - lo), 0), 1) AS scaled, lo, hi FROM orders, s)
    SELECT o_orderkey, round(scaled, 9) AS scaled, round(exp(scaled * (hi - lo) + lo), 4) AS back FROM x""")
def log_minmax_normalize(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders")
    logs = F.ln(F.greatest(F.lit(1.0), "o_totalprice"))
    limits = orders.agg(F.min(logs).alias("lo"), F.max(logs).alias("hi"))
    x = orders.crossJoin(F.broadcast(limits)).withColumn("scaled", S.log_scaled("o_totalprice", F.col("lo"), F.col("hi")))
    return x.select("o_orderkey", F.round("scaled", 9).alias("scaled"), F.round(S.log_unscaled("scaled", F.col("lo"), F.col("hi")), 4).alias("back"))


# --- splits and samples ---------------------------------------------------------------------------

_ORDERED = "q AS (SELECT q, length(q)::BIGINT AS len, row_number() OVER (PARTITION BY length(q) ORDER BY md5('0:' || q), q) AS place, count(*) OVER (PARTITION BY length(q)) AS n FROM (SELECT DISTINCT p_name AS q FROM part))"


def _sql_shares(rows: str, share: float, name: str) -> str:
    return f"""(SELECT len, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, len) <= missing THEN 1 ELSE 0 END AS {name} FROM
        (SELECT len, whole, rest, ceil(sum(n) OVER () * {share}::DOUBLE - 1e-9::DOUBLE) - sum(whole) OVER () AS missing FROM
            (SELECT len, count(*) AS n, floor(count(*) * {share}::DOUBLE) AS whole, count(*) * {share}::DOUBLE - floor(count(*) * {share}::DOUBLE) AS rest FROM {rows} GROUP BY len)))"""


@query(f"""WITH {_ORDERED}, t AS {_sql_shares('q', 0.1, 'n_test')}, a AS (SELECT q.*, n_test FROM q JOIN t ON q.len = t.len),
    r AS (SELECT * FROM a WHERE place > n_test), v AS {_sql_shares('r', 0.1 / 0.9, 'n_valid')}
    SELECT q, CASE WHEN place <= n_test THEN 'test' WHEN place <= n_test + coalesce(n_valid, 0) THEN 'valid' ELSE 'train' END AS split FROM a LEFT JOIN v ON a.len = v.len""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.three_way(_queries(spark, d)).select("q", "split")


@query(f"WITH {_ORDERED} SELECT q FROM q WHERE place <= greatest(1, floor(n * 0.3::DOUBLE))")
def stratified_downsample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.down_sample(_queries(spark, d), 0.3)


@query("SELECT p_name AS s, min(p_partkey) AS first FROM part GROUP BY 1")
def first_seen_order(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_seen(_rows(spark, d), "s", "rid")


@query("""WITH q AS (SELECT min(p_partkey) AS qid, p_name AS q FROM part GROUP BY 2), n AS (SELECT qid, count(*) AS new FROM (SELECT prefix, min(qid) AS qid FROM (SELECT qid, substr(q, 1, unnest(range(1, length(q) + 1))::INTEGER) AS prefix FROM q) GROUP BY 1) GROUP BY 1),
    r AS (SELECT q.qid, q, sum(coalesce(new, 0)) OVER (ORDER BY q.qid)::BIGINT AS n_prefixes FROM q LEFT JOIN n ON q.qid = n.qid) SELECT qid, q, n_prefixes FROM r WHERE n_prefixes <= 100""")
def prefix_budget(spark: SparkSession, d: str) -> DataFrame:
    q = _rows(spark, d).groupBy(F.col("s").alias("q")).agg(F.min("rid").alias("qid"))
    return sampling.within_prefix_budget(q, 100).select("qid", "q", "n_prefixes")


@query("SELECT length(p_name)::INTEGER AS len, count(*) AS n FROM part GROUP BY 1")
def length_groups(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).groupBy(F.length("s").alias("len")).agg(F.count("*").alias("n"))


@query("SELECT min(length(text))::INTEGER AS least, avg(length(text)) AS mean, max(length(text))::INTEGER AS most, count(*) AS n, lang FROM documents GROUP BY lang")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return _t(spark, d, "documents").groupBy("lang").agg(F.min(n).alias("least"), F.avg(n).alias("mean"), F.max(n).alias("most"), F.count("*").alias("n"))


@query("SELECT count(*) AS n_qry, (SELECT count(DISTINCT substr(p_name, 1, k::INTEGER)) FROM (SELECT p_name, unnest(range(1, length(p_name) + 1)) AS k FROM part)) AS n_prfx, sum(length(q))::BIGINT AS n_update FROM (SELECT DISTINCT p_name AS q FROM part)")
def training_stats(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d)
    return q.agg(F.count("*").alias("n_qry"), F.sum(F.length("q")).cast("long").alias("n_update")).crossJoin(count.distinct_queries(q, prefix_aug=True).agg(F.count("*").alias("n_prfx"))).select("n_qry", "n_prfx", "n_update")


@query(f"WITH {_PART} SELECT p_partkey, word, sum(card)::BIGINT AS cards FROM (SELECT p_partkey, p_name FROM part JOIN supplier ON p_partkey = s_suppkey) JOIN c ON word = p_name GROUP BY 1, 2")
def label_join(spark: SparkSession, d: str) -> DataFrame:
    """Cards by query for the parts that a semi-join leaves."""
    kept = _rows(spark, d).join(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("rid")), "rid", "left_semi")
    counts = count.approx_substring_count(_queries(spark, d), _names(spark, d), DELTA)
    return kept.join(counts, F.col("s") == F.col("word")).groupBy(F.col("rid").alias("p_partkey"), "word").agg(F.sum("card").alias("cards"))


# --- prefix summaries -----------------------------------------------------------------------------

_TREE = """t AS (SELECT prefix, substr(prefix, 1, length(prefix) - 1) AS parent, length(prefix)::INTEGER AS depth, count(*) + 1 AS frequency FROM (SELECT substr(p_name, 1, unnest(range(1, least(length(p_name), 20) + 1))::INTEGER) AS prefix FROM part) GROUP BY 1),
    k AS (SELECT parent, count(*) AS k, sum(frequency)::BIGINT AS total FROM t WHERE parent <> '' GROUP BY 1),
    e AS (SELECT t.parent AS node, t.prefix AS other, CASE WHEN total > 0 THEN frequency / total::DOUBLE * CASE WHEN length(t.parent) = 1 THEN 1.0::DOUBLE ELSE k / (k + 1)::DOUBLE END ELSE 0 END AS probability FROM t JOIN k ON t.parent = k.parent
          UNION ALL SELECT t.prefix, t.parent, 1.0::DOUBLE / (coalesce(k, 0) + 1) FROM t LEFT JOIN k ON k.parent = t.prefix WHERE t.parent <> '')"""


@query(f"WITH {_TREE} SELECT prefix, parent, depth, frequency FROM t")
def prefix_tree(spark: SparkSession, d: str) -> DataFrame:
    return summary.tree(_names(spark, d))


@query(f"WITH {_TREE} SELECT node, other, round(probability, 9) AS probability FROM e")
def transition_probabilities(spark: SparkSession, d: str) -> DataFrame:
    return summary.transitions(summary.tree(_names(spark, d))).select("node", "other", F.round("probability", 9).alias("probability"))


@query(f"WITH {_TREE} SELECT node, other, round(sum(probability), 9) AS weight FROM (SELECT * FROM e UNION ALL SELECT a.node, b.other, a.probability * b.probability FROM e a JOIN e b ON a.other = b.node) GROUP BY 1, 2")
def two_hop_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return summary.neighbours(summary.transitions(summary.tree(_names(spark, d)))).select("node", "other", F.round("weight", 9).alias("weight"))


def _sql_number(*of: str) -> str:
    return f"(('0x' || substr(md5({' || \':\' || '.join(of)}), 1, 13))::BIGINT / {float(16**13)!r}::DOUBLE)"


@query(f"""WITH {_TREE}, n AS (SELECT prefix, row_number() OVER (ORDER BY md5(prefix), prefix) AS place, count(*) OVER () AS whole FROM t),
    u AS (SELECT node, other, sum(probability) OVER (PARTITION BY node ORDER BY other) AS high, sum(probability) OVER (PARTITION BY node) AS total, row_number() OVER (PARTITION BY node ORDER BY other) = count(*) OVER (PARTITION BY node) AS last FROM e WHERE probability > 0),
    a AS (SELECT prefix AS node, unnest(range(4)) AS draw FROM t),
    f AS (SELECT a.node, draw, min(other) AS other FROM a JOIN u ON a.node = u.node AND ({_sql_number("'1234'", "a.node", "draw::VARCHAR")} < high / total OR last) GROUP BY 1, 2),
    w AS (SELECT node, draw, other FROM f WHERE {_sql_number("'1234:steps'", "node", "draw::VARCHAR")} >= 0.5
          UNION ALL SELECT f.node, draw, min(u.other) FROM f JOIN u ON u.node = f.other AND ({_sql_number("'1234:second'", "f.node", "draw::VARCHAR")} < high OR last) WHERE {_sql_number("'1234:steps'", "f.node", "draw::VARCHAR")} < 0.5 GROUP BY 1, 2)
    SELECT a.node AS "Anchor", a.draw::INTEGER AS draw, coalesce(w.other, a.node) AS "Positive", n.prefix AS "Negative"
    FROM a JOIN n ON n.place = ('0x' || substr(md5('1234:n:' || a.node || ':' || a.draw), 1, 13))::BIGINT % n.whole + 1 LEFT JOIN w ON w.node = a.node AND w.draw = a.draw""")
def triplets(spark: SparkSession, d: str) -> DataFrame:
    return summary.triplets(summary.tree(_names(spark, d)))


@query(f"WITH {_TREE} SELECT prefix, parent, depth, frequency FROM t ORDER BY frequency DESC, depth, prefix LIMIT (SELECT floor(count(*) * 0.25)::BIGINT FROM t)")
def summary_pruned(spark: SparkSession, d: str) -> DataFrame:
    return summary.pruned(summary.tree(_names(spark, d)), 0.25)


@query(f"WITH {_TREE} SELECT a.prefix, count(*) AS n_below, count(*) FILTER (a.frequency = b.frequency) AS n_same FROM t a JOIN t b ON starts_with(b.prefix, a.prefix) GROUP BY 1")
def subtree_counts(spark: SparkSession, d: str) -> DataFrame:
    return summary.below(summary.tree(_names(spark, d)))


@query(f"WITH {_PREFIXED}, {_TREE} SELECT t.prefix, t.parent, t.depth, coalesce(c.card + 1, t.frequency) AS frequency FROM t LEFT JOIN c ON c.word = t.prefix AND c.delta = 1 WHERE coalesce(c.card + 1, t.frequency) > 1")
def frequency_override(spark: SparkSession, d: str) -> DataFrame:
    """The tree with counts within one edit in place of its own."""
    q = _queries(spark, d)
    cards = count.approx_substring_count(q.select(F.explode(T.prefixes("q")).alias("q")), _names(spark, d), 1).where("delta = 1")
    return summary.overridden(summary.tree(_names(spark, d)), cards.select(F.col("word").alias("prefix"), "card"))


# --- experiments ----------------------------------------------------------------------------------


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as experiment records: the user is the key and the type the table."""
    return _t(spark, d, "events").select(F.col("event_type").alias("tbl"), F.col("user_id").cast("string").alias("exp_key"), F.col("props").alias("value"), F.col("event_id").alias("at"))


@query("SELECT event_type AS tbl, user_id::VARCHAR AS exp_key, arg_max(props, event_id) AS value, max(event_id) AS at FROM events GROUP BY 1, 2")
def runs_latest_status(spark: SparkSession, d: str) -> DataFrame:
    return runs.latest(_runs(spark, d))


@query("""WITH l AS (SELECT event_type AS tbl, user_id::VARCHAR AS exp_key, json_extract(arg_max(props, event_id), '$.k')::BIGINT AS k FROM events GROUP BY 1, 2)
    SELECT exp_key, max(k) FILTER (tbl = 'click') AS click, max(k) FILTER (tbl = 'view') AS view, max(k) FILTER (tbl = 'error') AS error FROM l GROUP BY 1""")
def runs_pivot(spark: SparkSession, d: str) -> DataFrame:
    last = runs.latest(_runs(spark, d)).withColumn("k", runs.field("value", "k", "bigint"))
    return runs.pivoted(last, "exp_key", "tbl", ["click", "view", "error"], "k")


@query("""WITH l AS (SELECT event_type AS tbl, user_id AS u, json_extract(arg_max(props, event_id), '$.k')::DOUBLE AS k FROM events GROUP BY 1, 2)
    SELECT c_custkey, a.k AS clicked, b.k AS failed FROM customer JOIN l a ON a.tbl = 'click' AND a.u = c_custkey JOIN l b ON b.tbl = 'error' AND b.u = c_custkey""")
def run_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Customers beside the last values of two tables of records under their key; those that lack one are left out."""
    params = _t(spark, d, "customer").select("c_custkey")
    return runs.lookup(params, F.col("c_custkey").cast("string"), runs.latest(_runs(spark, d)), {"clicked": ("click", "k"), "failed": ("error", "k")})


@query("SELECT event_type, user_id, avg(value) AS value_mean, round(stddev_samp(value), 9) AS value_std, count(*) AS n FROM (SELECT event_type, user_id, value, event_id FROM events) GROUP BY 1, 2")
def seed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select("event_type", "user_id", "value", "event_id")
    out = runs.aggregated(rows, "event_id", ["value"])
    return out.withColumn("value_std", F.round("value_std", 9))


@query("SELECT event_id, value FROM events WHERE NOT coalesce(value < 2 OR value > 20, false)")
def clip_filter(spark: SparkSession, d: str) -> DataFrame:
    return runs.clipped(_t(spark, d, "events").select("event_id", "value"), "value", 2, 20)


@query("SELECT m, s::VARCHAR AS s, '--m ' || m || ' --s ' || s AS key FROM (SELECT unnest(['trie', 'block']) AS m), (SELECT unnest([0, 1, 2]) AS s)")
def cartesian_params(spark: SparkSession, d: str) -> DataFrame:
    out = runs.expanded(spark, {"m": ["trie", "block"], "s": [0, 1, 2]})
    return out.withColumn("key", runs.command_line(["m", "s"]))


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_brand IN ('Brand#1', 'Brand#2') AND p_name IS NOT NULL")
def dict_match(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"type": "PROMO", "brand": ["Brand#1", "Brand#2"], "name": "*"}
    return _t(spark, d, "part").where(runs.matches({"type": "p_type", "brand": "p_brand", "name": "p_name"}, wanted)).select("p_partkey")


@query("SELECT ts::VARCHAR[1:10] || ' ' || '00:00' AS log_time, event_type AS alg, user_id AS n_qry, event_id AS n_rec, user_id AS n_prfx, 2::INTEGER AS d, user_id % 2 = 0 AS p, CASE WHEN value > 3 THEN value - 3 END AS time FROM (SELECT * REPLACE (round(value, 2) AS value) FROM events)".replace("ts::VARCHAR[1:10]", "strftime(ts, '%Y-%m-%d')").replace("value - 3 END", "round(value - 3, 2) END"))
def timing_log_parse(spark: SparkSession, d: str) -> DataFrame:
    """Log lines made of events, read back into columns."""
    e = _t(spark, d, "events")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.lit("00:00"), "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.lit("2"), (F.col("user_id") % 2 == 0).cast("string"), F.round(F.round("value", 2) - 3, 2).cast("string"))
    return runs.timings(e.select(line.alias("value")))


# --- learned estimators ---------------------------------------------------------------------------


def _truth(spark: SparkSession, d: str) -> DataFrame:
    prefixes = count.distinct_queries(_queries(spark, d), prefix_aug=True)
    return count.approx_substring_count(prefixes, _names(spark, d), DELTA).withColumnRenamed("word", "q")


def _judged(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Fitted to the training split of all prefixes, judged on the test split."""
        found = models.evaluate(name, _truth(spark, d), _names(spark, d).count(), strings=_rows(spark, d))
        return found.groupBy("delta").agg(F.count("*").alias("n"), F.avg("q_err").alias("q_err"), F.avg("q_err_eps").alias("q_err_eps"))

    return run


for _name in [*models.ESTIMATORS, "patterns"]:
    query(None, f"estimator_{_name}")(_judged(_name))
