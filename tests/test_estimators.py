"""Statistics, patterns, trees, splits and learned estimators."""

import itertools
import re

import numpy as np
import pytest

from substrata.functions.text import WILDCARD
from substrata.operators import count, lbs, models, sampling, summary
from substrata.plans import kernels
from substrata.plans.autodiff import Node, Parameters, joined


@pytest.mark.parametrize("query,d", [("ab", 0), ("ab", 1), ("abc", 1), ("aab", 2), ("ab", 2), ("abcd", 2)])
def test_minimal_patterns_say_who_is_near(query, d):
    """A string is within d edits exactly if it holds a pattern (or is too short for the wildcards that insertions make)."""
    found = lbs.minimal_patterns(query, d)
    compiled = [re.compile("".join("." if x == WILDCARD else re.escape(x) for x in p)) for p in found]
    for n in range(7):
        for letters in itertools.product("abcd" if n < 5 else "ab", repeat=n):
            s = "".join(letters)
            assert any(c.search(s) for c in compiled) == (kernels.sed(query, s) <= d)
    assert list(found) == sorted(found, key=lambda p: (len(p), p.replace(WILDCARD, "\0")))


def test_lbs_estimates(spark):
    strings = ["abcd", "abxd", "zbcd", "qqqq", "abcd", "abc"]
    rows = spark.createDataFrame(list(enumerate(strings)), "rid long, s string")
    table = lbs.build(rows, n=4, least=1).cache()
    counts = {r.token: r.cnt for r in table.collect()}
    assert counts[""] == 6 and counts["abcd"] == 2 and counts["ab" + WILDCARD + "d"] == 3
    q = spark.createDataFrame([("abcd", 0), ("abcd", 1), ("zz", 0), ("ab", 2)], "q string, delta int")
    found = {(r.q, r.delta): r.estimate for r in lbs.estimate(q, table, n=4).collect()}
    assert found["abcd", 0] == 2 and found["zz", 0] == 0 and found["ab", 2] == 6
    assert 2 <= found["abcd", 1] <= 40
    long = {r.q: r.estimate for r in lbs.estimate(spark.createDataFrame([("abcd", 0)], "q string, delta int"), lbs.build(rows, n=3, least=1), n=3).collect()}
    assert long["abcd"] == pytest.approx(3 * (3 / 3), abs=2)


def test_tree_walk_probabilities(spark):
    nodes = summary.tree(spark.createDataFrame([("ab",), ("ac",), ("abd",), ("b",)], "s string"))
    freq = {r.prefix: r.frequency for r in nodes.collect()}
    assert freq == {"a": 4, "ab": 3, "ac": 2, "abd": 2, "b": 2}
    total = {}
    for r in summary.transitions(nodes).collect():
        total[r.node] = total.get(r.node, 0) + r.probability
    assert total == pytest.approx({"a": 1, "ab": 1, "ac": 1, "abd": 1})
    found = summary.triplets(nodes).collect()
    assert len(found) == 4 * len(freq) and {r.Anchor for r in found} == set(freq) and {r.Negative for r in found} <= set(freq)
    assert {r.Positive for r in found if r.Anchor == "b"} == {"b"}


def test_split_is_disjoint_and_stratified(spark):
    q = spark.createDataFrame([(f"{'x' * (k % 5)}{k:03d}",) for k in range(200)], "q string")
    rows = sampling.three_way(q).collect()
    size = {s: sum(r.split == s for r in rows) for s in ("test", "valid", "train")}
    assert len(rows) == 200 and size == {"test": 20, "valid": 20, "train": 160}
    assert {len(r.q) for r in rows if r.split == "test"} == {3, 4, 5, 6, 7}
    assert sampling.down_sample(q, 0.001).count() == 5


def test_autodiff_against_differences():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(4, 3)), rng.normal(size=(3, 5))

    def loss(x, y):
        h = joined([(x @ y).tanh(), (x @ y).softplus()]).leaky().cumsum()
        return (h[:, 1:7].sigmoid() * h[np.array([0, 0, 2, 1]), :6].exp().log1p()).square().mean()

    x, y = Node(a), Node(b)
    out = loss(x, y)
    out.backward()
    for node, value in ((x, a), (y, b)):
        for at in np.ndindex(value.shape):
            moved = value.copy()
            moved[at] += 1e-6
            other = loss(*(Node(moved if n is node else v) for n, v in ((x, a), (y, b))))
            assert (other.value - out.value) / 1e-6 == pytest.approx(node.slope[at], abs=1e-4)
    p = Parameters()
    first = [float((p.dense("w", Node(a), 1) - 1.0).square().mean().value)]
    for _ in range(200):
        p.step((p.dense("w", Node(a), 1) - 1.0).square().mean(), 0.02)
    assert float((p.dense("w", Node(a), 1) - 1.0).square().mean().value) < first[0] / 10


@pytest.mark.parametrize("name", sorted(models.ESTIMATORS))
def test_estimators_beat_a_constant(spark, data, name):
    names = spark.read.parquet(f"{data}/part.parquet").selectExpr("p_name AS s")
    prefixes = count.distinct_queries(names.withColumnRenamed("s", "q"), prefix_aug=True)
    truth = count.approx_substring_count(prefixes, names, 2).withColumnRenamed("word", "q").cache()
    rows = truth.join(sampling.three_way(prefixes), "q").cache()
    part = lambda s: rows.where(f"split = '{s}'").select("q", "delta", "card")
    model = models.ESTIMATORS[name](names.count()).fit(part("train"), part("valid"))
    test = part("test").toPandas()
    found = model.transform(part("test").select("q", "delta")).toPandas()
    both = test.merge(found, on=["q", "delta"])
    assert len(both) == len(test) and both.estimate.between(0, names.count()).all()
    constant = np.expm1(np.log1p(part("train").toPandas().card).mean())
    assert models.q_errors(both.card, both.estimate).mean() < models.q_errors(both.card, np.full(len(both), constant)).mean()
    ordered = both.sort_values(["q", "delta"]).groupby("q").estimate
    assert ordered.apply(lambda e: (np.diff(e) >= -1e-9).all()).all()


def test_patterns_as_an_estimator(spark, data):
    """It is nearer than a constant, holds to the range, and says what it lacks."""
    rows = spark.read.parquet(f"{data}/part.parquet").selectExpr("p_partkey AS rid", "p_name AS s")
    prefixes = count.distinct_queries(rows.selectExpr("s AS q"), prefix_aug=True).where("length(q) <= 8")
    truth = count.approx_substring_count(prefixes, rows, 1).withColumnRenamed("word", "q")
    model = models.PatternStatistics(rows.count(), rows, ngram=4, least=1).fit(truth, truth.limit(0))
    both = truth.toPandas().merge(model.transform(truth.select("q", "delta")).toPandas(), on=["q", "delta"])
    assert len(both) == truth.count() and both.estimate.between(0, rows.count()).all() and model.coverage > 0
    constant = np.expm1(np.log1p(both.card).mean())
    assert models.q_errors(both.card, both.estimate).mean() < models.q_errors(both.card, np.full(len(both), constant)).mean()
    with pytest.raises(ValueError, match="needs the strings"):
        models.evaluate("patterns", truth, 1)


def test_distances_in_sql(spark):
    from substrata.functions import sql

    sql.register(spark)
    for q, s in (("abc", "xxabxcxx"), ("", "a"), ("ab", ""), ("né😀", "ne😀"), ("aaaa", "bbbb"), ("kitten", "sitting on")):
        found = spark.sql("SELECT sed(:q, :s) AS d, sed_within(:q, :s, 1) AS near", {"q": q, "s": s}).first()
        assert (found.d, found.near) == (kernels.sed(q, s), kernels.sed(q, s) <= 1)
    assert spark.sql("SELECT sed(NULL, 'a') AS d").first().d is None


@pytest.mark.parametrize("q,s", [("abcdef", "xxabcdefx"), ("abcdef", "abxdef"), ("aabbcc", "ccbbaa"), ("abcdefg", ""), ("ab", "ba")])
def test_gram_bound_is_no_more_than_the_distance(spark, q, s):
    from substrata.functions import text

    found = spark.createDataFrame([(q, s)], "q string, s string").select(*[text.gram_bound("q", "s", n).alias(f"g{n}") for n in (1, 2, 3)]).first()
    assert max(found) <= kernels.sed(q, s)


def test_live_cells_count_their_work():
    """Shared and pruned rows: no more lines than without, and cells only where they can lead to something."""
    q, s, w = ["abcd", "abce", "zzzz"], ["xxabcdxx", "qqqqqqqq"], np.array([1, 2])
    sums = {name: np.zeros(2, np.int64) for name in ("all", "pruned", "live")}
    a = kernels.shared_prefix(q, s, w, 1, prune=False, work=sums["all"])
    b = kernels.shared_prefix(q, s, w, 1, work=sums["pruned"])
    c = kernels.live_cells(q, s, w, 1, work=sums["live"])
    assert (a == b).all() and (a == c).all()
    assert sums["all"][0] > sums["pruned"][0] == sums["live"][0] and sums["live"][1] < sums["pruned"][1]


def test_estimate_command(spark, data, tmp_path):
    from substrata.__main__ import main
    from substrata.sources import experiments, files

    names = spark.read.parquet(f"{data}/part.parquet").selectExpr("p_name AS s")
    files.write_counts_long(count.approx_substring_count(count.distinct_queries(names, "s", prefix_aug=True), names, 1), f"{tmp_path}/c")
    main(["estimate", f"{tmp_path}/c", "--strings", "200", "--model", "sequence", "--out", f"{tmp_path}/o", "--store", f"{tmp_path}/s"], spark)
    assert "0.99" in experiments.scan(spark, f"{tmp_path}/s", "est").first().value
    assert spark.read.parquet(f"{tmp_path}/o/sequence/crosstab").where("delta IS NULL AND len IS NULL").count() == 1
    model = models.Sequence(200, most_delta=1)
    model.alphabet = {"a": 2}
    rows = spark.createDataFrame([("a", 0), ("b", 1)], "q string, delta int")
    assert models.latency(model, rows) > 0
    with pytest.raises(ValueError, match="threshold of 1"):
        models.Sequence(200).estimates(["a"], np.array([1]))
    with pytest.raises(ValueError, match="up to 3"):
        models.Monotone(200, 3).estimates(["abcd"], np.array([0]))
    model = models.Sequence(200)
    model.alphabet = {"a": 2, "b": 3, "c": 4}
    found = model.predict(*model.encode(["a" * 30 + "b", "a" * 30 + "c"])).value  # before it is cut to 0..n
    assert found[0, 0] != found[1, 0]
    with pytest.raises(ValueError, match="no estimator"):
        models.evaluate("magic", rows, 1)
