"""Grids of runs, time limits and reports."""

import time

import pytest

from substrata.__main__ import main
from substrata.operators import job
from substrata.sources import experiments, files, reports


def test_grid_of_counts(spark, tmp_path, capsys):
    (tmp_path / "s.txt").write_text("abc\nabd\nxyz\n")
    (tmp_path / "q.txt").write_text("ab\nyy\n")
    store, out = f"{tmp_path}/store", f"{tmp_path}/out"
    args = ["count", f"{tmp_path}/s.txt", "--queries", f"{tmp_path}/q.txt", "--alg", "block", "trie", "naive", "--delta", "1", "--out", out, "--store", store]
    main(args, spark)
    states = [r.value for r in experiments.scan(spark, store, "status").collect()]
    assert states == ['{"status": 2}'] * 3
    table = files.counts_long(spark, f"{out}/res/q_trie_1.0_0_01_base.txt")
    assert sorted(map(tuple, table.collect())) == [("ab", 0, 2), ("ab", 1, 2), ("yy", 0, 0), ("yy", 1, 1)]
    before = spark.read.parquet(store).count()
    main(args, spark)  # nothing is left to do
    assert spark.read.parquet(store).count() == before
    main(["report", store, "--table", "join"], spark)
    assert capsys.readouterr().out.count("<tr>") == 4
    with pytest.raises(SystemExit):
        main(["count", "x", "--queries", "y", "--delta", "-1", "--out", "o", "--store", "s"], spark)


def test_limits_and_failures(spark):
    began = time.monotonic()
    status, took = job.limited(spark, lambda: spark.range(200_000_000_000).selectExpr("sum(hash(id))").collect(), 3.0)
    assert status == job.TIMEOUT and took < 40 and time.monotonic() - began < 45
    assert job.limited(spark, lambda: 1 / 0, None)[0] == job.FAIL
    assert job.limited(spark, lambda: spark.range(3).count(), 60)[0] == job.DONE


def test_html(spark):
    text = reports.to_html(spark.createDataFrame([("<a>", 1.234, None)], "k string, v double, n int"), "t")
    assert "&lt;a&gt;" in text and "1.23" in text and "<td></td>" in text
