"""Plans: what is read, joined and shuffled."""

import re

import pytest

from substrata.operators import count, metrics
from substrata.plans.catalogue import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,columns", [("approx_count_partition_part", "p_name:string"), ("clip_filter", "event_id:bigint,value:double"), ("weighted_mean", "l_quantity:double,l_extendedprice:double,l_returnflag:string,l_linestatus:string")])
def test_scans_read_what_is_used(spark, data, name, columns):
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, data)))) == {columns}


def test_filters_reach_the_scan(spark, data):
    assert "EqualTo(p_type,PROMO)" in plan(QUERIES["dict_match"](spark, data))


@pytest.mark.parametrize("name", ["approx_count_partition_part", "approx_count_qgram_part", "qgram_postings", "eqt_counts", "prefix_tree", "qerror_cube", "two_hop_neighbors"])
def test_no_python_and_no_cartesian_product(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text
    if "qerror" not in name:
        assert "Python" not in text and "Arrow" not in text


def test_strings_are_weighed_before_the_shuffle(spark, data):
    text = plan(count.collapsed(spark.read.parquet(f"{data}/part.parquet").selectExpr("p_name AS s")))
    assert text.count("Exchange") == 1 and "partial_" in text


def test_queries_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(count, "MOST_QUERY_CHARS", 5)
    q, s = spark.createDataFrame([("abcd",), ("bcde",)], "q string"), spark.createDataFrame([("abcd",), ("xbcdx",)], "s string")
    with pytest.raises(ValueError, match="partition"):
        count.approx_substring_count(q, s, 1, strategy="block")
    assert sorted(map(tuple, count.approx_substring_count(q, s, 1).collect())) == [("abcd", 0, 1), ("abcd", 1, 2), ("bcde", 0, 0), ("bcde", 1, 2)]


def test_quantiles_from_sketches(spark):
    rows = spark.range(1000).selectExpr("double(id) AS q_err")
    exact, near = ({r.level: r.value for r in metrics.quantiles(rows, accuracy=a).collect()} for a in (None, 10000))
    assert all(abs(exact[k] - near[k]) <= 1 for k in exact)


def test_a_large_table_is_counted_where_it_is_read(spark, data):
    lines = spark.read.parquet(f"{data}/documents.parquet").selectExpr("explode(split(text, '\\n')) AS s")
    q = spark.createDataFrame([("the",), ("ouer",)], "q string")
    kernel = plan(count.STRATEGIES["block"](q, count.weighted(lines), 1, False))
    assert "Exchange" not in kernel[kernel.index("MapInArrow") :]
    found = count.approx_substring_count(q, lines, 1, strategy="block", collapse=False, spread=False)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, count.approx_substring_count(q, lines, 1, strategy="trie").collect()))
