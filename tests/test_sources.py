"""Readers, writers, the experiment store and streams."""

import pytest

from substrata.operators import runs
from substrata.sources import experiments, files
from substrata.streaming import counts as streaming


def test_strings_and_queries(spark, tmp_path):
    (tmp_path / "s.txt").write_bytes("ab \n\nnan\né😀\n\n".encode() + b"\xff\xfe\n")
    assert [r.s for r in files.strings(spark, str(tmp_path / "s.txt")).collect()] == ["ab ", "nan", "é😀"]
    assert [r.q for r in files.queries(spark, str(tmp_path / "s.txt")).collect()] == ["ab", "", "nan", "é😀", ""]
    assert [files.resolved_count(x, 10) for x in ("0.3", "500", "0", "0.01", "4")] == [3, 10, 10, 1, 4]
    assert files.some(files.strings(spark, str(tmp_path / "s.txt")), "2").count() == 2


def test_counts_survive_csv(spark, tmp_path):
    rows = [("a,b", 0, 3), ('say "x"', 0, 1), ("nan", 0, 0), ("NULL", 1, 2), (" ab ", 0, 7)]
    df = spark.createDataFrame(rows, "word string, delta int, card bigint")
    files.write_counts_long(df, f"{tmp_path}/long")
    assert sorted(map(tuple, files.counts_long(spark, f"{tmp_path}/long").collect())) == sorted(rows)
    cards = spark.createDataFrame([("ab", 0, [5, 2]), ("a,", 1, [9, 1])], "word string, delta int, cards array<bigint>")
    files.write_counts_long(cards, f"{tmp_path}/cards")
    assert sorted((r.word, r.cards) for r in files.prefix_counts_long(spark, f"{tmp_path}/cards").collect()) == [("a,", [9, 1]), ("ab", [5, 2])]
    table = spark.createDataFrame([("x", 1, 2, 3)], 'word string, `0` bigint, `1` bigint, `2` bigint')
    files.write_counts_wide(table, f"{tmp_path}/wide")
    assert [(r.word, r.cards) for r in files.counts_wide(spark, f"{tmp_path}/wide", 1).collect()] == [("x", [1, 2])]
    assert [r.line for r in files.as_line(df.where("word = 'a,b'")).collect()] == ['"a,b",0,3']
    assert files.save_name("qs", "trie", 2, True) == "res/qs_trie_02_prefix.txt"


def test_experiments(spark, tmp_path):
    path = f"{tmp_path}/runs"
    experiments.put(spark, path, "join", "--d 3 --a x", {"time": 1.5})
    experiments.put(spark, path, "join", "--d 3 --a x", {"time": 2.5})
    experiments.put(spark, path, "est", "--d 3 --a x", {"err": 3})
    found = experiments.scan(spark, path, "join", "--d ?*x").select(runs.field("value", "time", "double").alias("time")).collect()
    assert [r.time for r in found] == [2.5]


def test_logs_and_queries_on_columns(spark):
    lines = spark.createDataFrame([("2022-01-01 10:00:00 trie 5 100 5 3 True 1.5",), ("2022-01-01 10:00:00 trie 5 100 5 3 False -1",), ("noise",)], "value string")
    assert [(r.p, r.time, r.d) for r in runs.timings(lines).collect()] == [(True, 1.5, 3), (False, None, 3)]
    work = spark.createDataFrame([("2022-01-01 10:00:00 9 8 7 6 5 4",)], "value string")
    assert runs.work_lines(work).first().pruned_cell == 4
    rows = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", None), ("d", 9.0)], "k string, v double")
    assert [r.k for r in runs.clipped(rows, "v", 2, 5).collect()] == ["b", "c"]
    assert [r.k for r in rows.where(runs.matches({"k": "k"}, {"k": ["a", "d"]})).collect()] == ["a", "d"]
    assert rows.where(runs.matches({"k": "k"}, {"missing": 1})).count() == 0
    assert [r.k for r in runs.in_order(rows, "k", ["d", "a"]).collect()] == ["d", "a", "b", "c"]


@pytest.mark.parametrize("files_a_time", [1, 3])
def test_stream_equals_batch(spark, tmp_path, files_a_time):
    for k in range(3):
        spark.createDataFrame([("abc",), (f"xab{k}",), (None,)], "s string").coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    stream = spark.readStream.schema("s string").option("maxFilesPerTrigger", files_a_time).parquet(f"{tmp_path}/in*")
    found = streaming.run_to_end(streaming.streaming_histogram(stream, ["abc", "ab"], 1), f"t{files_a_time}")
    assert sorted(map(tuple, found.collect())) == [("ab", 0, 6), ("abc", 0, 3), ("abc", 1, 3)]


def test_cache_builds_once(spark, tmp_path):
    from substrata.operators import lbs
    from substrata.sources import cache

    rows, built = spark.createDataFrame([(0, "abc"), (1, "abd")], "rid long, s string"), []

    def build():
        built.append(1)
        return lbs.build(rows, n=3, least=1, hashes=2)

    found = [cache.cached(spark, str(tmp_path), "grams", p, build, "token").orderBy("token").collect() for p in ({"n": 3, "least": 1}, {"least": 1, "n": 3}, {"n": 4})]
    assert found[0] == found[1] and len(built) == 2
    assert next(r.cnt for r in found[0] if r.token == "ab") == 2
