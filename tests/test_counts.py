"""Strategies and kernels against plain dynamic programming."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from substrata.functions import text as T
from substrata.operators import count
from substrata.plans import kernels

ODD = ["a,b", '"x"', "ab ", "a?b", "50%", "a_b", "a\\b", "é", "日本", "a😀b", "", "abcabc", "abcabc", "nan", "NULL"]


def truth(queries, strings, delta):
    out = {}
    for q in set(queries):
        d = [kernels.sed(q, s) for s in strings]
        for k in range(delta + 1):
            out[q, k] = sum(x <= k for x in d)
    return out


@given(st.lists(st.text("abé😀", max_size=7), min_size=1, max_size=6), st.lists(st.text("abé😀", max_size=9), max_size=8))
@settings(max_examples=60, deadline=None)
def test_kernels_agree(queries, strings):
    queries = sorted(set(queries))
    weights = np.arange(1, len(strings) + 1)
    expected = np.zeros((len(queries), 3), int)
    for i, q in enumerate(queries):
        for s, w in zip(strings, weights, strict=True):
            if (d := kernels.sed(q, s)) <= 2:
                expected[i, d] += w
    for name, kernel in kernels.KERNELS.items():
        assert (kernel(queries, strings, weights, 2) == expected).all(), name


@pytest.mark.parametrize("length", [63, 64, 65, 130])
def test_kernels_at_word_limits(length):
    r = random.Random(length)
    q = "".join(r.choice("ACGT") for _ in range(length))
    s = "GG" + q[: length // 2] + "A" + q[length // 2 + 1 :] + "TT"
    for kernel in kernels.KERNELS.values():
        found = kernel([q], [s, q], np.array([1, 1]), 2)
        assert found.sum() == 2 and found[0, 0] >= 1


@pytest.mark.parametrize("strategy", sorted(count.STRATEGIES))
def test_strategies_agree(spark, strategy):
    r = random.Random(5)
    strings = ODD + ["".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(30)]
    queries = ["ab", "abc", "abcab", "a,b", '"x"', "ab ", "a?b", "日木", "e", "abcabcabcabc", "ab", "é", "a😀b"]
    s = spark.createDataFrame([(x,) for x in [*strings, None]], "s string")
    q = spark.createDataFrame([(x,) for x in [*queries, None]], "q string")
    found = {(x.word, x.delta): x.card for x in count.approx_substring_count(q, s, 2, strategy=strategy).collect()}
    assert found == truth(queries, strings, 2)


@pytest.mark.parametrize("strategy", ["trie", "partition"])
def test_prefix_counts(spark, strategy):
    strings = ["abcab", "abd", "xbc", "abcab"]
    s = spark.createDataFrame([(x,) for x in strings], "s string")
    q = spark.createDataFrame([("abc",), ("abx",), ("abc",)], "q string")
    for r in count.prefix_counts(q, s, 1, strategy=strategy).collect():
        expected = truth([r.word[:k] for k in range(1, len(r.word) + 1)], strings, 1)
        assert r.cards == [expected[r.word[:k], r.delta] for k in range(1, len(r.word) + 1)]
        assert r.cards == sorted(r.cards, reverse=True)


def test_count_docs_query_on_a_fixture(spark, tmp_path):
    from substrata.plans.catalogue import QUERIES

    spark.createDataFrame([(1, "The thne; pears"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["a thnex line\nother lnie", "pear here", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.word, r.delta): r.card for r in QUERIES["approx_count_block_docs"](spark, str(tmp_path)).collect()}
    lines = [x for t in texts if t for x in t.split("\n")]
    assert found == truth(["the", "thne", "pears"], lines, 1)


def test_count_docs_query_takes_words_of_any_length(spark, tmp_path):
    from substrata.plans.catalogue import QUERIES

    long = "contextualisation"
    spark.createDataFrame([(1, f"A, the; {long} {'x' * 70}"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [f"a thx line\nother {long[:-1]}", "th", "y" + "x" * 69, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.word, r.delta): r.card for r in QUERIES["approx_count_block_docs"](spark, str(tmp_path)).collect()}
    assert found == truth(["a", "the", long, "x" * 70], [x for t in texts if t for x in t.split("\n")], 1)


def test_pieces_equal_the_block_kernel():
    r = random.Random(11)
    for delta, alphabet in ((0, "abc"), (1, "abc"), (1, "ab-é😀]^"), (2, "ab")):
        queries = sorted({"".join(r.choice(alphabet[:3]) for _ in range(r.randint(0, 7))) for _ in range(120)} | {"ab" * 33, "a" * 64})
        strings = ["".join(r.choice(alphabet + "X -") for _ in range(r.choice([0, 1, 3, 12, 40]))) for _ in range(300)] + ["ab" * 16 + "x" + "ab" * 17, "a" * 63, "a" * 65]
        weights = np.array([r.choice([1, 1, 3, 300]) for _ in strings])
        assert (kernels.pieces(queries, strings, weights, delta) == kernels.bit_parallel(queries, strings, weights, delta)).all()


def test_many_queries_are_not_compared_with_every_line(spark, monkeypatch):
    """The work of a long list of words is that of the strings' pieces, not of words times characters."""
    r = random.Random(12)
    words = sorted({"".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(1500)})
    lines = [" ".join(r.choice(words) for _ in range(12)) for _ in range(200)]
    monkeypatch.setitem(kernels.KERNELS, "block", None)
    monkeypatch.delitem(count.STRATEGIES, "block")
    q, s = (spark.createDataFrame([(x,) for x in rows], f"{name} string") for rows, name in ((words, "q"), (lines, "s")))
    found = {(x.word, x.delta): x.card for x in count.approx_substring_count(q, s, 1).collect()}
    some = words[::30]
    assert {k: n for k, n in found.items() if k[0] in some} == truth(some, lines, 1)


def test_empty_database_and_unknown_strategy(spark):
    s, q = spark.createDataFrame([], "s string"), spark.createDataFrame([("ab",)], "q string")
    assert [r.card for r in count.approx_substring_count(q, s, 1).collect()] == [0, 0]
    with pytest.raises(ValueError, match="no strategy"):
        count.approx_substring_count(q, s, 1, strategy="magic")


def test_sed_expressions(spark):
    r = random.Random(2)
    pairs = [("".join(r.choice("abé") for _ in range(r.randint(1, 6))), "".join(r.choice("abé") for _ in range(r.randint(0, 9)))) for _ in range(80)] + [("abcdef", "cd"), ("ab", "")]
    rows = spark.createDataFrame(pairs, "q string, s string").select("q", "s", T.sed("q", "s").alias("full"), T.sed_within("q", "s", 2).alias("near"), T.sed_within("q", "s", 2, banded=True).alias("banded")).collect()
    for x in rows:
        d = kernels.sed(x.q, x.s)
        assert x.full == d
        assert min(x.near, 3) == min(d, 3) == min(x.banded, 3)


def test_filters_lose_nothing(spark):
    r = random.Random(8)
    s = spark.createDataFrame([("".join(r.choice("ab") for _ in range(r.randint(0, 10))), 1) for _ in range(40)], "s string, w long").dropDuplicates(["s"])
    q = spark.createDataFrame([("".join(r.choice("ab") for _ in range(r.randint(1, 8))),) for _ in range(15)], "q string").distinct()
    near = {(a.q, b.s) for a in q.collect() for b in s.collect() if kernels.sed(a.q, b.s) <= 2}
    for make in (count.partition_candidates, count.gram_candidates):
        assert near <= {(x.q, x.s) for x in make(q, s, 2).select("q", "s").collect()}


def test_wide_and_long(spark):
    s = spark.createDataFrame([("abc",), ("abd",)], "s string")
    q = spark.createDataFrame([("abc",), ("zz",)], "q string")
    counts = count.approx_substring_count(q, s, 1)
    back = count.long(count.wide(counts, 1), 1)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, counts.collect()))


def test_text_expressions(spark):
    row = spark.createDataFrame([("a😀b", "x/y.tar.gz")], "s string, p string").select(
        T.prefixes("s").alias("prefixes"), T.suffixes("s", 2).alias("suffixes"), T.qgrams("s", 2).alias("grams"), T.qgrams("s", 5).alias("none"), T.parts("s", 2).alias("parts"), T.masks(F.substring("s", 1, 2)).alias("masks"),
        T.extension("p").alias("extension"), T.stem("p").alias("stem"), T.code_points("s").alias("points"), T.padded(T.code_points("s"), 5).alias("padded"),
    ).first()
    w = T.WILDCARD
    assert row.prefixes == ["a", "a😀", "a😀b"] and row.suffixes == ["b", "😀b"] and row.grams == ["a😀", "😀b"] and row.none == []
    assert row.parts == ["a😀", "b"] and sorted(row.masks) == sorted(["a😀", w + "😀", "a" + w, w + w])
    assert (row.extension, row.stem) == ("gz", "y.tar") and row.points == [97, 128512, 98] and row.padded == [97, 128512, 98, 0, 0]


def test_violations(spark):
    strings = spark.createDataFrame([(x,) for x in ("abc", "abd", "x", "")], "s string")
    q = spark.createDataFrame([("abc",)], "q string").select(F.explode(T.prefixes("q")).alias("q"))
    counts = count.approx_substring_count(q, strings, 2)
    assert count.violations(counts, 4).count() == 0
    wrong = spark.createDataFrame([("a", 0, 2), ("a", 1, 1), ("ab", 0, 3), ("b", 0, 9), ("b", 1, 2)], "word string, delta int, card long")
    assert {(r.word, r.delta): r.reason for r in count.violations(wrong, 4).collect()} == {("a", 1): "falls with the threshold", ("ab", 0): "more than its prefix", ("b", 0): "out of range", ("b", 1): "falls with the threshold"}


def test_intersections_and_alphabets(spark):
    from substrata.functions import stats as S
    from substrata.operators import encode, runs

    rows = spark.createDataFrame([([4, 2], [[1, 5, 3, 9], [1, 5, 7, 9]])], "n array<long>, sigs array<array<long>>")
    assert rows.select(S.intersection_size("n", "sigs").alias("x")).first().x == pytest.approx(4 / 1.0 * 0.75)
    codes = encode.lookup(encode.alphabet(spark.createDataFrame([("bca",)], "s string")))
    words = spark.createDataFrame([("cab",)], "s string")
    assert words.select(encode.strictly_encoded("s", codes).alias("x")).first().x == [2, 0, 1]
    with pytest.raises(Exception, match="not in the alphabet"):
        spark.createDataFrame([("z",)], "s string").select(encode.strictly_encoded("s", codes)).collect()
    records = spark.createDataFrame([("join", "k1", '{"t": 2}', 1), ("est", "k1", '{"e": 3}', 1), ("join", "k2", '{"t": 2}', 1), ("est", "k2", "Traceback", 1)], runs.SCHEMA)
    params = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "k string")
    assert [tuple(r) for r in runs.lookup(params, F.col("k"), records, {"t": ("join", "t"), "e": ("est", "e")}).collect()] == [("k1", 2.0, 3.0)]
