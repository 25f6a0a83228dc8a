"""Queries that write and read the engine's files, stores and reports, and that join and look up their rows, each beside its SQL.

They write to the work folder that all machines share and read back what they wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from substrata.functions import sql
from substrata.functions import stats as S
from substrata.functions import text as T
from substrata.operators import count, index, job, lbs, metrics, runs, sampling, summary
from substrata.plans.catalogue import _GRAMS, _ORDERED, _PART, _PREFIXED, _SIGNED, _WILDCARDS, COEFFICIENTS, DELTA, ORACLES, QUERIES, _names, _queries, _rows, _signatures, _sql_shares, _t, query
from substrata.sources import cache, experiments, files, reports
from substrata.sources.work import work_path

# --- lines ----------------------------------------------------------------------------------------

#: Part names as raw lines: some with white space behind, some empty.
_RAW = "SELECT CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE '' END END AS line FROM part"


def _lines(spark: SparkSession, d: str) -> str:
    path = work_path(spark, "lines")
    key = F.col("p_partkey")
    text = F.when(key % 11 == 0, "").otherwise(F.concat("p_name", F.when(key % 7 == 0, "  ").otherwise("")))
    _t(spark, d, "part").select(text.alias("value")).write.text(path)
    return path


@query(f"SELECT line AS s, count(*) AS n FROM ({_RAW}) WHERE line <> '' GROUP BY 1")
def lines_as_strings(spark: SparkSession, d: str) -> DataFrame:
    """Whole lines, empty ones left out."""
    return files.strings(spark, _lines(spark, d)).groupBy("s").agg(F.count("*").alias("n"))


@query(f"SELECT rtrim(line) AS q, count(*) AS n FROM ({_RAW}) GROUP BY 1")
def lines_as_queries(spark: SparkSession, d: str) -> DataFrame:
    """Lines without white space behind, empty ones kept."""
    return files.queries(spark, _lines(spark, d)).groupBy("q").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT count(*) AS n FROM part) SELECT number, CASE number WHEN '0.3' THEN greatest(floor(0.3::DOUBLE * n), 1) WHEN '0.0001' THEN greatest(floor(0.0001::DOUBLE * n), 1) WHEN '50' THEN least(50, n) ELSE n END::BIGINT AS rows FROM n, (SELECT unnest(['0.3', '0.0001', '50', '0', '1.0']) AS number)")
def resolved_row_counts(spark: SparkSession, d: str) -> DataFrame:
    """What "0.3", "50" and "0" of a file stand for."""
    n = files.strings(spark, _lines(spark, d), keep_empty=True).count()
    return spark.createDataFrame([(x, files.resolved_count(x, n)) for x in ("0.3", "0.0001", "50", "0", "1.0")], "number string, rows bigint")


@query("SELECT p_name AS s, p_partkey AS rid FROM part ORDER BY md5('3:{\"rid\":' || p_partkey || ',\"s\":\"' || p_name || '\"}') LIMIT (SELECT floor(0.3::DOUBLE * count(*))::BIGINT FROM part)")
def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    """A share of the rows by the hash of their values: the same ones in every run."""
    return files.some(_rows(spark, d), "0.3", 3)


@query("SELECT p_name AS s FROM (SELECT DISTINCT p_name FROM part) ORDER BY md5('5:' || p_name), p_name LIMIT 20")
def drawn_without_replacement(spark: SparkSession, d: str) -> DataFrame:
    return sampling.without_replacement(_names(spark, d).distinct(), 20, "s", "5")


@query(f"WITH {_PART} SELECT word AS line, length(word)::INTEGER AS n FROM c WHERE delta = 0")
def sorted_query_file(spark: SparkSession, d: str) -> DataFrame:
    """Written in code-point order and read as whole lines."""
    path = work_path(spark, "queries")
    files.write_strings(_queries(spark, d), path)
    return files.strings(spark, path, column="line").withColumn("n", F.length("line"))


_SPLIT = f"""{_ORDERED}, t AS {_sql_shares('q', 0.1, 'n_test')}, a AS (SELECT q.*, n_test FROM q JOIN t ON q.len = t.len),
    r AS (SELECT * FROM a WHERE place > n_test), v AS {_sql_shares('r', 0.1 / 0.9, 'n_valid')},
    l AS (SELECT q, CASE WHEN place <= n_test THEN 'test' WHEN place <= n_test + coalesce(n_valid, 0) THEN 'valid' ELSE 'train' END AS split FROM a LEFT JOIN v ON a.len = v.len)"""


@query(f"WITH {_SPLIT} SELECT q FROM l WHERE split IN ('train', 'valid')")
def train_and_valid_queries(spark: SparkSession, d: str) -> DataFrame:
    """The two splits put together, written and read back."""
    split = sampling.three_way(_queries(spark, d)).select("q", "split")
    path = work_path(spark, "train")
    files.write_strings(split.where("split = 'train'").unionByName(split.where("split = 'valid'")), path)
    return files.queries(spark, path)


# --- count tables ---------------------------------------------------------------------------------


def _counts(spark: SparkSession, d: str, delta: int = DELTA) -> DataFrame:
    return count.approx_substring_count(_queries(spark, d), _names(spark, d), delta)


@query(f"WITH {_PART} SELECT word, delta, card FROM c")
def long_table_file(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "long")
    files.write_counts_long(_counts(spark, d), path)
    return files.counts_long(spark, path)


@query(f"WITH {_PART} SELECT word, list(card ORDER BY delta)[1] AS c0, list(card ORDER BY delta)[2] AS c1 FROM c GROUP BY 1")
def wide_table_file(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds up to 2 are written and up to 1 read."""
    path = work_path(spark, "wide")
    files.write_counts_wide(count.wide(_counts(spark, d), DELTA), path)
    return files.counts_wide(spark, path, 1).select("word", F.col("cards")[0].alias("c0"), F.col("cards")[1].alias("c1"))


@query(f"""WITH {_PREFIXED}, w AS (SELECT DISTINCT p_name AS word FROM part), p AS (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w)
    SELECT p.word, c.delta, p.k::INTEGER AS k, c.card FROM p JOIN c ON c.word = substr(p.word, 1, p.k)""")
def prefix_table_file(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all prefixes, c1:c2:... in the file, a row for each prefix here."""
    path = work_path(spark, "prefix")
    files.write_counts_long(count.prefix_counts(_queries(spark, d), _names(spark, d), 1), path)
    return files.prefix_counts_long(spark, path).select("word", "delta", F.posexplode("cards").alias("k", "card")).withColumn("k", F.col("k") + 1)


@query(f"WITH {_PART} SELECT word || ',' || delta || ',' || card AS line FROM c")
def count_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.as_line(_counts(spark, d))


@query("SELECT string, count(*) AS selectivity FROM (SELECT substr(p_name, 1, unnest(range(1, least(length(p_name), 20) + 1))::INTEGER) AS string FROM part) GROUP BY 1")
def selectivity_file(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "selectivity")
    files.write_selectivities(summary.selectivities(summary.tree(_names(spark, d))), path)
    return files.selectivities(spark, path)


@query("SELECT DISTINCT p_name AS \"Anchor\", p_type AS \"Positive\", p_brand AS \"Negative\" FROM part")
def triplet_file(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "triplets")
    files.write_triplets(_t(spark, d, "part").select(F.col("p_name").alias("Anchor"), F.col("p_type").alias("Positive"), F.col("p_brand").alias("Negative")).distinct(), path)
    return files.triplets(spark, path)


@query("SELECT alg, d::INTEGER AS d, p, 'res/parts_' || alg || '_' || lpad(d::VARCHAR, 2, '0') || CASE WHEN p THEN '_prefix' ELSE '_base' END || '.txt' AS name FROM (SELECT unnest(['trie', 'block']) AS alg), (SELECT unnest([1, 12]) AS d), (SELECT unnest([true, false]) AS p)")
def result_names(spark: SparkSession, d: str) -> DataFrame:
    rows = [(alg, k, p, files.save_name("parts", alg, k, p)) for alg in ("trie", "block") for k in (1, 12) for p in (True, False)]
    return spark.createDataFrame(rows, "alg string, d int, p boolean, name string")


_SPOILT = f"""{_PART}, n AS (SELECT count(*) AS n FROM part), x AS (SELECT word, delta, CASE WHEN ascii(word) % 5 = 0 AND delta = 1 THEN -1 WHEN ascii(word) % 5 = 1 AND delta = 2 THEN card - 1 WHEN ascii(word) % 5 = 2 AND delta = 0 THEN n + 1 ELSE card END AS card, n FROM c, n),
    y AS (SELECT *, lag(card) OVER (PARTITION BY word ORDER BY delta) AS before FROM x)"""


@query(f"WITH {_SPOILT} SELECT word, delta, card, CASE WHEN card < 0 OR card > n THEN 'out of range' ELSE 'falls with the threshold' END AS reason FROM y WHERE card < 0 OR card > n OR card < before")
def broken_counts(spark: SparkSession, d: str) -> DataFrame:
    """The checks of a count table, on one with planted errors."""
    n, code = _t(spark, d, "part").count(), F.ascii("word") % 5
    card = F.when((code == 0) & (F.col("delta") == 1), -1).when((code == 1) & (F.col("delta") == 2), F.col("card") - 1).when((code == 2) & (F.col("delta") == 0), n + 1).otherwise(F.col("card"))
    return count.violations(_counts(spark, d).withColumn("card", card.cast("long")), n)


@query(f"""WITH {_PREFIXED}, r AS (SELECT count(*) AS n_rec, sum(length(p_name))::BIGINT AS s_len FROM part), k AS (SELECT q AS prefix, length(q) AS depth FROM q),
    a AS (SELECT coalesce(sum(CASE WHEN depth = 1 THEN n_rec ELSE c.card END), 0)::BIGINT AS computed FROM k CROSS JOIN r LEFT JOIN c ON c.word = substr(prefix, 1, depth - 1) AND c.delta = 1),
    t AS (SELECT sum(length(q))::BIGINT AS q_len FROM (SELECT DISTINCT p_name AS q FROM part))
    SELECT strategy, (q_len * n_rec)::BIGINT AS total_line, CASE strategy WHEN 'sorted' THEN (SELECT count(*) FROM k) * n_rec ELSE computed END::BIGINT AS computed_line,
           CASE strategy WHEN 'sorted' THEN 0 ELSE (SELECT count(*) FROM k) * n_rec - computed END::BIGINT AS pruned_line FROM a, r, t, (SELECT unnest(['sorted', 'sorted_pruned', 'trie']) AS strategy)""")
def measured_work(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the distance table that the shared-prefix strategies computed, shared and pruned, as counted by the kernels."""
    return count.measured(_queries(spark, d), _names(spark, d), 1).select("strategy", "total_line", "computed_line", "pruned_line")


@query(f"WITH {_PART} SELECT word AS q, card AS n FROM c WHERE delta = 1 AND word IN (SELECT p_name FROM part WHERE p_partkey <= 40)")
def distance_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """Counts within one edit by the SQL function alone."""
    sql.register(spark)
    s = count.collapsed(_names(spark, d))
    q = _rows(spark, d).where("rid <= 40").select(F.col("s").alias("q")).distinct()
    near = F.broadcast(q).crossJoin(s).where(F.expr("sed_within(q, s, 1)"))
    return near.groupBy("q").agg(F.sum("w").alias("n"))


# --- labels and lookups ---------------------------------------------------------------------------


@query(f"WITH {_SPLIT}, s AS{_PART.split('), s AS', 1)[1]} SELECT split, l.q, delta, card FROM l JOIN c ON c.word = l.q")
def labels_of_splits(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the queries of each split."""
    split = sampling.three_way(_queries(spark, d)).select("q", "split")
    return count.labels(split, _counts(spark, d)).select("split", "q", "delta", "card")


@query(f"""WITH {_PREFIXED}, w AS (SELECT p_partkey AS qid, p_name AS word FROM part WHERE p_partkey <= 50), p AS (SELECT qid, word, unnest(range(1, length(word) + 1)) AS k FROM w)
    SELECT qid, substr(p.word, 1, k) AS q, k::INTEGER AS k, delta, card FROM p JOIN c ON c.word = substr(p.word, 1, p.k)""")
def labels_of_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Labels of every prefix of a query, for training with an output at each character."""
    prefixes = count.distinct_queries(_queries(spark, d), prefix_aug=True)
    counts = count.approx_substring_count(prefixes, _names(spark, d), 1)
    return count.labels(_rows(spark, d).where("rid <= 50").select(F.col("rid").alias("qid"), F.col("s").alias("q")), counts, prefixes=True).select("qid", "q", "k", "delta", "card")


@query("WITH v AS (SELECT row_number() OVER (ORDER BY p_partkey DESC) - 1 AS spot, p_name AS value FROM part WHERE p_partkey % 5 = 0), r AS (SELECT p_name AS value, min(p_partkey) AS rid FROM part GROUP BY 1) SELECT spot, v.value, rid FROM v JOIN r ON v.value = r.value")
def rows_of_values(spark: SparkSession, d: str) -> DataFrame:
    """For each value of a list, in its order, the row that holds it."""
    wanted = sampling.in_sequence(_rows(spark, d).where("rid % 5 = 0").select(F.col("s").alias("value"), "rid"), [F.desc("rid")], "spot").select((F.col("spot") - 1).alias("spot"), "value")
    table = _rows(spark, d).groupBy(F.col("s").alias("value")).agg(F.min("rid").alias("rid"))
    return sampling.rows_of(wanted, table, "value")


@query(f"WITH {_PART}, e AS (SELECT word AS q, delta, card / 2.0::DOUBLE AS estimate FROM c WHERE length(word) % 2 = 0) SELECT word AS q, c.delta, card, estimate FROM c LEFT JOIN e ON e.q = word AND e.delta = c.delta")
def estimates_by_query_and_threshold(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d).withColumnRenamed("word", "q")
    found = counts.where(F.length("q") % 2 == 0).select("q", "delta", (F.col("card") / 2.0).alias("estimate"))
    return counts.join(found, ["q", "delta"], "left")


@query(f"WITH {_PART} SELECT p_partkey AS qid, word, delta, card FROM part JOIN c ON word = p_name WHERE p_partkey % 3 = 0")
def packed_test_rows(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of counts of the occurrences of queries, packed and unpacked."""
    test = _rows(spark, d).where("rid % 3 = 0").select(F.col("rid").alias("qid"), F.col("s").alias("q"))
    return count.unpacked(test.select("qid", F.col("q").alias("word")).join(count.packed(_counts(spark, d)), "word"))


@query("""WITH q AS (SELECT min(p_partkey) AS qid, p_name AS q FROM part GROUP BY 2), f AS (SELECT prefix, min(qid) AS qid FROM (SELECT qid, substr(q, 1, unnest(range(1, length(q) + 1))::INTEGER) AS prefix FROM q) GROUP BY 1)
    SELECT prefix, row_number() OVER (ORDER BY qid, length(prefix)) AS slot FROM f""")
def new_prefix_slots(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of prefixes in the order in which queries bring them."""
    return sampling.prefix_slots(_rows(spark, d).groupBy(F.col("s").alias("q")).agg(F.min("rid").alias("qid")))


@query(f"WITH {_PART} SELECT word, delta, card, card - coalesce(lag(card) OVER (PARTITION BY word ORDER BY delta), 0) AS step, sum(card) OVER (PARTITION BY word ORDER BY delta)::BIGINT AS so_far FROM c")
def steps_over_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Steps from one threshold to the next, and the running sum over them."""
    return count.steps(_counts(spark, d))


@query(f"WITH {_PART} SELECT word FROM c WHERE delta = 2 ORDER BY card DESC, length(word), word LIMIT 25")
def longest_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The words of the largest counts, of equal ones the shortest and then the first."""
    return _counts(spark, d).where("delta = 2").orderBy(F.desc("card"), F.length("word"), "word").limit(25).select("word")


# --- indexes and patterns -------------------------------------------------------------------------


@query(f"WITH {_WILDCARDS} SELECT token, count(*) AS cnt FROM k GROUP BY 1 HAVING count(*) >= 30")
def cached_index(spark: SparkSession, d: str) -> DataFrame:
    """Wildcard n-grams in 30 rows or more: built, kept under the name of its parameters and read by a second look."""
    folder = work_path(spark, "indexes")
    build = lambda: index.checked(index.extended_table(_rows(spark, d), 3, 30), 30)
    cache.cached(spark, folder, "eqt", {"n": 3, "least": 30}, build, "token")
    return cache.cached(spark, folder, "eqt", {"least": 30, "n": 3}, build, "token")


@query(f"WITH {_GRAMS} SELECT token, string_agg(rid::VARCHAR, ' ' ORDER BY rid) AS rids FROM (SELECT DISTINCT rid, token FROM g WHERE rid <= 300) GROUP BY 1")
def posting_file(spark: SparkSession, d: str) -> DataFrame:
    """Posting lists as lines of a token and its ids, written and parsed."""
    path = work_path(spark, "postings")
    files.write_postings(index.postings(_rows(spark, d).where("rid <= 300"), T.qgrams("s", 2)), path)
    return files.postings(spark, path).groupBy("token").agg(F.array_join(F.sort_array(F.flatten(F.collect_list("rids"))).cast("array<string>"), " ").alias("rids"))


@query("SELECT p_partkey AS rid, length(p_name) = length(q) AND p_name LIKE replace(q, '?', '_') AS whole FROM part, (SELECT substr(min(p_name), 1, 1) || '?' || substr(min(p_name), 3) AS q FROM part)")
def wildcard_whole_match(spark: SparkSession, d: str) -> DataFrame:
    """Strings that are the pattern, its second character any one."""
    least = _names(spark, d).agg(F.min("s").alias("q"))
    pattern = least.select(F.concat(F.substring("q", 1, 1), F.lit(T.WILDCARD), F.expr("substring(q, 3)")).alias("q"))
    return _rows(spark, d).crossJoin(F.broadcast(pattern)).select("rid", T.matches_pattern("s", "q").alias("whole"))


_TWICE = " + ".join(f"(a.h{k} = b.h{k})::INTEGER" for k in range(10))
_LARGER = " + ".join(f"(CASE WHEN a.cnt >= b.cnt THEN a.h{k} ELSE b.h{k} END = least(a.h{k}, b.h{k}))::INTEGER" for k in range(10))


@query(f"""WITH {_SIGNED} SELECT a.token, b.token AS other, round(greatest(a.cnt, b.cnt) / greatest(({_LARGER}) / 10.0::DOUBLE, greatest(a.cnt, b.cnt) / (a.cnt + b.cnt)::DOUBLE) * (({_TWICE}) / 10.0::DOUBLE), 6) AS n_both
    FROM sig a JOIN sig b ON substr(a.token, 1, 1) = substr(b.token, 1, 1) AND a.token < b.token""")
def intersection_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Rows that hold both of two 2-grams, from their counts and signatures."""
    x = _signatures(spark, d).withColumn("lead", F.substring("token", 1, 1))
    y = x.select("lead", F.col("token").alias("other"), F.col("cnt").alias("cnt2"), F.col("sig").alias("sig2"))
    size = S.intersection_size(F.array("cnt", "cnt2"), F.array("sig", "sig2"))
    return x.join(y, "lead").where("token < other").select("token", "other", F.round(size, 6).alias("n_both"))


@query(f"""WITH {_WILDCARDS}, x AS (SELECT token, count(*) AS cnt FROM k GROUP BY 1),
    w AS (SELECT q, n, pos, substr(q, pos::INTEGER, 3) AS token FROM (SELECT q, length(q) - 2 AS n, unnest(range(1, length(q) - 1)) AS pos FROM (SELECT DISTINCT p_name AS q FROM part))),
    l AS (SELECT q, n, list(CASE WHEN pos = 1 THEN a.cnt::DOUBLE ELSE a.cnt / b.cnt::DOUBLE END ORDER BY pos) AS steps FROM w JOIN x a ON a.token = w.token JOIN x b ON b.token = substr(w.token, 1, 2) GROUP BY 1, 2)
    SELECT q, round(list_reduce(steps, lambda f, s: f * s), 6) AS freq FROM l WHERE len(steps) = n""")
def chained_windows(spark: SparkSession, d: str) -> DataFrame:
    """Names longer than the n-grams: the product of their windows' counts over those of the overlaps."""
    found = _queries(spark, d).select("q", F.lit(0).alias("delta"), F.lit(0).alias("ord"), F.col("q").alias("pattern"))
    table = index.extended_signatures(_rows(spark, d), 3, COEFFICIENTS)
    return lbs.pattern_counts(found, table, n=3).select("q", F.round("freq", 6).alias("freq"))


@query("SELECT word, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1 ORDER BY frequency DESC, word LIMIT 500")
def word_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Words of all documents, the 500 most frequent."""
    words = summary.words(_t(spark, d, "documents"), "text", r"[a-z]+")
    return sampling.in_sequence(words, [F.desc("frequency"), "string"], "place").where("place <= 500").select(F.col("string").alias("word"), "frequency")


@query("SELECT prefix, depth, row_number() OVER (ORDER BY depth, prefix) AS place FROM (SELECT DISTINCT prefix, length(prefix)::INTEGER AS depth FROM (SELECT substr(p_name, 1, unnest(range(1, least(length(p_name), 20) + 1))::INTEGER) AS prefix FROM part))")
def level_order(spark: SparkSession, d: str) -> DataFrame:
    """The tree's nodes level by level."""
    return sampling.in_sequence(summary.tree(_names(spark, d)), [summary.level_order(None)], "place").select("prefix", "depth", "place")


# --- runs and reports -----------------------------------------------------------------------------


@query("SELECT event_type AS tbl, user_id::VARCHAR AS exp_key, arg_max(props, event_id) AS value FROM events WHERE event_type = 'click' AND user_id::VARCHAR LIKE '1%_' GROUP BY 1, 2")
def experiment_scan(spark: SparkSession, d: str) -> DataFrame:
    """A store of records, appended to twice, looked up by table and key pattern."""
    path = work_path(spark, "store")
    events = _t(spark, d, "events").select(F.col("event_type").alias("tbl"), F.col("user_id").cast("string").alias("exp_key"), F.col("props").alias("value"), F.col("event_id").alias("at"))
    events.where("at % 2 = 0").write.parquet(path)
    events.where("at % 2 = 1").write.mode("append").parquet(path)
    return experiments.scan(spark, path, "click", "1*?").select("tbl", "exp_key", "value")


@query(f"WITH {_PART} SELECT alg, word, delta, card FROM c, (SELECT unnest(['block', 'partition']) AS alg)")
def counting_jobs(spark: SparkSession, d: str) -> DataFrame:
    """A grid of jobs over files, its status and time recorded, and the tables that it wrote."""
    names, store, out = work_path(spark, "names"), work_path(spark, "runs"), work_path(spark, "out")
    _names(spark, d).select(F.col("s").alias("value")).write.text(names)
    jobs = list(job.Grid({"strings": [names], "queries": [names], "alg": ["block", "partition"], "delta": [DELTA]}).jobs())
    job.run(spark, iter(jobs), store, out)
    done = experiments.scan(spark, store, "status").where("get_json_object(value, '$.status') = '2'").count()
    if done != len(jobs):
        raise ValueError(f"{len(jobs) - done} jobs failed")
    tables = [files.counts_long(spark, x.out(out)).select(F.lit(x.alg).alias("alg"), "word", "delta", "card") for x in jobs]
    return tables[0].unionByName(tables[1])


@query("SELECT event_type AS alg, user_id AS n_qry, event_id AS total_line, event_id // 2 AS computed_line FROM events")
def work_log(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a work log, written and parsed."""
    path = work_path(spark, "log")
    e = _t(spark, d, "events")
    n = F.floor(F.col("event_id") / 2)
    line = F.concat_ws(" ", F.lit("2022-01-01"), F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")), "event_id", n.cast("string"), F.lit("0"), "event_id", n.cast("string"), F.lit("0"))
    e.select(line.alias("value")).write.text(path)
    found = runs.work_lines(spark.read.text(path))
    alg = F.split(F.substring_index("log_time", " ", -1), ":")
    return found.select(alg[0].alias("alg"), alg[1].cast("long").alias("n_qry"), "total_line", "computed_line")


@query("SELECT '<table><caption>regions</caption>' || chr(10) || '<tr><th>r_regionkey</th><th>r_name</th></tr>' || chr(10) || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>', chr(10) ORDER BY r_regionkey) || chr(10) || '</table>' || chr(10) AS page FROM region")
def html_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.createDataFrame([(reports.to_html(rows, "regions"),)], "page string")


@query("WITH x AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 10 = 1 THEN 'Infinity'::DOUBLE WHEN event_id % 10 = 2 THEN NULL ELSE value END AS value FROM events) SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'nan' WHEN 1 THEN 'infinite' ELSE 'null' END AS problem FROM x WHERE event_id % 10 < 3")
def values_that_are_no_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 10
    e = _t(spark, d, "events").withColumn("value", F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(None)).otherwise(F.col("value")))
    return metrics.not_finite(e, "value").select("event_id", "problem")


@query("SELECT event_type, printf('%.1f%%', 100.0::DOUBLE * count(*) / (SELECT count(*) FROM events)) AS share, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' ELSE event_type END AS label FROM events GROUP BY 1")
def percent_and_labels(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    n = e.count()
    out = e.groupBy("event_type").agg(runs.percent(F.count("*") / F.lit(n)).alias("share"))
    return out.select("event_type", "share", runs.labelled("event_type", {"click": "Click", "view": "View"}).alias("label"))


@query(f"WITH {_PART} SELECT word, delta, q_err FROM (SELECT word, delta, greatest(greatest(card, 1) / greatest(length(word), 1)::DOUBLE, greatest(length(word), 1) / greatest(card, 1)::DOUBLE) AS q_err FROM c) QUALIFY row_number() OVER (PARTITION BY delta ORDER BY q_err DESC, word) <= 3")
def worst_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The three queries of the largest error at each threshold; the guess is the query's length."""
    rows = metrics.with_errors(_counts(spark, d).withColumn("estimate", F.length("word").cast("double")))
    return runs.nth(rows, ["delta"], [F.desc("q_err"), F.col("word")], 3).select("word", "delta", "q_err")


@query("SELECT event_type, count(*) AS n, (row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_type) - 1) AS place FROM events GROUP BY 1")
def reports_in_a_given_order(spark: SparkSession, d: str) -> DataFrame:
    counts = _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    ordered = runs.in_order(counts, "event_type", ["view", "click"])
    return sampling.in_sequence(ordered, [runs.place_in("event_type", ["view", "click"]), "event_type"], "place").withColumn("place", F.col("place") - 1)
