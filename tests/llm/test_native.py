"""Fingerprints, mixing, line dedup and sharding: against plain versions and SQL."""

import hashlib
import random
import time
import zlib

import pytest
import xxhash
from conftest import same_rows
from llm.helpers import SCHEMA, empty_documents, odd_documents, prose
from pyspark.sql import functions as F

from substrata.llm import fingerprints, line_dedup, mixing, queries, sharding


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    same_rows(queries.QUERIES[name](spark, data), duck.sql(queries.ORACLES[name]))


# --- sharding


def test_sharding_odd_cases(spark):
    df, rows = odd_documents(spark, extra=True)
    out = sharding.shard_documents(df, sharding.Topology.even(5)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(x[1] for x in rows if x[0] == r.doc_id and (r.size == len((x[1] or "").encode()) + 1)) or ""
        assert r.text_crc32 == zlib.crc32(text.encode()) and r.grown_shard in (r.shard, 5)
    for s in range(5):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in out if r.doc_id == 9}) == 1 and len({r.shard for r in out if r.doc_id is None}) == 1
    assert sharding.shard_documents(empty_documents(spark), sharding.Topology.even(3)).count() == 0
    back = sharding.placed(df, sharding.Topology.even(5))
    assert back.count() == len(rows) and set(df.columns) <= set(back.columns) and dict(back.dtypes)["slot"] == "bigint"


def test_sharding_is_fair_and_moves_little(spark):
    ids = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text")
    t = sharding.Topology((sharding.Leaf(0, 0, 0, 1.0), sharding.Leaf(0, 1, 1, 3.0), sharding.Leaf(1, 0, 2, 4.0)))
    sizes = {r.shard: r["count"] for r in sharding.locate(ids, t).groupBy("shard").count().collect()}
    assert sizes == pytest.approx({0: 2500, 1: 7500, 2: 10000}, rel=0.06)
    heavier = sharding.Topology((*t.leaves[:1], sharding.Leaf(0, 1, 1, 5.0), t.leaves[2]))
    moved = sharding.locate(ids, t).withColumnRenamed("shard", "old").join(sharding.locate(ids, heavier).select("doc_id", "shard"), "doc_id").where("old <> shard")
    assert {r.shard for r in moved.select("shard").distinct().collect()} == {0, 1}  # only into the region that grew, within it to the heavier rack by share
    assert moved.where("old = 2").count() == pytest.approx(2000, rel=0.1)
    assert moved.where("old = 1").count() == 0
    grown = sharding.shard_documents(ids, sharding.Topology.even(16)).where("shard <> grown_shard")
    assert {r.grown_shard for r in grown.collect()} == {16} and grown.count() == pytest.approx(20000 / 17, rel=0.1)
    with pytest.raises(ValueError):
        sharding.locate(ids, sharding.Topology(()))


def test_placement_of_many_shards_and_clashing_names(spark):
    topology = sharding.Topology.even(400)
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "concat('t', id) AS text", "id AS slot", "id AS bucket", "id AS place", "id AS row", "id AS at", "id AS start", "id AS n")
    began = time.time()
    out = sharding.placed(df, topology, slot_buckets=8).collect()
    assert time.time() - began < 30
    assert len(out) == 3000 and len({r.shard for r in out if r.doc_id is None}) == 1 and len({r.shard for r in out}) > 380
    assert all(r.bucket == r.place == r.row == r["at"] == r.start == r.n for r in out)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.placed(empty_documents(spark), topology).count() == sharding.shard_documents(empty_documents(spark), topology).count() == 0
    hashed = df.where("doc_id IS NULL").selectExpr("doc_id", "length(text) + 1L AS size", "crc32(CAST(text AS binary)) AS text_crc32", "0 AS shard")
    assert sharding._slotted(hashed, 1, 1024).count() == 1000


def test_shards_on_disk(spark, tmp_path):
    df, rows = odd_documents(spark)
    sharding.write_shards(df, sharding.Topology.even(4), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == len(rows)


# --- mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped = {}
    while True:
        left = sum(sizes.values()) - sum(capped.values())
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 1, "d": 100, None: 3}, {"z": 0, "y": 7}, {"é": 5, "z": 5, "😀": 5, "a": 90}])
def test_targets(spark, sizes):
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert found == pytest.approx(plain_targets(sizes))
    assert sum(found.values()) == pytest.approx(sum(sizes.values()))


def test_targets_by_name(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100), (None, 100)], "source string, source_size long")
    found = {r.source: (r.target, r.rate) for r in mixing.targets(sizes, {"a": 3, "b": 1, None: 0.0}).collect()}
    assert found == {"a": (300.0, 3.0), "b": (100.0, 1.0), "c": (0.0, 0.0), None: (0.0, 0.0)}
    assert {r.target for r in mixing.targets(sizes, {"a": 1}).collect()} == {300.0, 0.0}


def test_mixing_odd_cases(spark):
    df, rows = odd_documents(spark, extra=True)
    out = mixing.with_copies(df).collect()
    again = mixing.with_copies(df).collect()
    key = lambda r: (str(r.row.doc_id), str(r.row.text), r.copies)
    assert len(out) == len(rows) and sorted(map(key, out)) == sorted(map(key, again))
    assert all(0 <= r.copies <= 3 for r in out)
    assert {r["size"] for r in out if r.row.text is None} == {0}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("settle", [True, False])
def test_mix_against_a_plain_version(spark, settle):
    """Copies by hand, with columns named as the operator's own, documents without words, a capped source and one of target 0."""
    r = random.Random(5)
    rows = [(k, "w " * (r.randrange(9) if k % 4 else 0), "abcd"[0 if k % 2 else k % 3 + 1]) for k in range(900)] + [(901, "one two", "z"), (902, "", "z"), (903, "", "none"), (904, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ("__bin", "__size", "size", "row", "copies", "number", "of", "source_size", "target", "limit", "whole", "bin")
    for name in names:
        df = df.withColumn(name, F.concat(F.lit("odd "), F.col("doc_id")))
    weights = {"a": 1, "b": 2, "c": 0.0, "z": 100, "none": 5}
    got, kept = {}, mixing.mix(df, weights, settle=settle).collect()
    for x in kept:
        assert all(x[n] == f"odd {x.doc_id}" for n in names)
        got[x.doc_id] = got.get(x.doc_id, 0) + 1
    size = {k: len((t or "").split()) for k, t, _ in rows}
    total = {s: sum(size[k] for k, _, x in rows if x == s) for s in "abcdz"}
    targets = {x.source: x.rate for x in mixing.targets(spark.createDataFrame(list(total.items()), "source string, source_size long"), weights).collect()}
    drawn = {k: (int(hashlib.md5(f"mix:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13 for k, _, _ in rows}
    for s in "abcdz":
        mine = [k for k, _, x in rows if x == s]
        whole, part = divmod(targets[s], 1)
        limit = part
        if settle:
            need, bins = part * total[s], {}
            for k in mine:
                bins[int(drawn[k] * mixing.BINS)] = bins.get(int(drawn[k] * mixing.BINS), 0) + size[k]
            limit, so_far = 0.0, 0
            for b in sorted(bins):
                so_far += bins[b]
                if bins[b] and need > 1e-9 and so_far - bins[b] / 2 <= need:
                    limit = (b + 1) / mixing.BINS
        assert {k: got.get(k, 0) for k in mine} == {k: int(whole) + (drawn[k] < limit) for k in mine}
    assert got[901] == got[902] == 3 and not {903, 904} & got.keys()


def test_plain_draws_have_the_share_of_the_fraction(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'w w' AS text", "concat('s', id % 2) AS source")
    for settle in (True, False):
        extra = {r.source: r.share for r in mixing.with_copies(df, (3, 5), settle=settle).groupBy("row.source").agg(F.avg(F.col("copies") - F.lit(0)).alias("share")).collect()}
        assert extra["s0"] == pytest.approx(0.75, abs=0.012) and extra["s1"] == pytest.approx(1.25, abs=0.012)


def test_mixing_comes_near_its_targets(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', 1 + int(id % 7)) AS text", "concat('s', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 20 END) AS source")
    out = mixing.with_copies(df).groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    for r in out:
        assert abs(r.taken - r.target) <= 8  # half of a bin, which holds a few documents of up to 7 words


# --- line dedup


def test_line_dedup_odd_cases(spark):
    df, rows = odd_documents(spark, extra=True)
    out = line_dedup.dedup_lines(df).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    assert by_id[3].text is None and by_id[4].text == "" and by_id[5].text == " \n\t \n" and by_id[6].n_removed == 0
    assert line_dedup.dedup_lines(empty_documents(spark)).count() == 0


def test_line_dedup_windows(spark):
    p = ["one line", "two line", "three line", "four line"]
    texts = [(1, "\n".join(["head", *p])), (2, "\n".join(["x", p[0], "", " two  line", p[2], "", p[3], "y"])), (3, "\n".join(p[:2])), (4, "\n".join(p[:3] + ["z"] + p[:3])), (5, "\n".join(p)), (5, "\n".join(p))]
    out = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert out == [(1, texts[0][1], 0), (2, "x\n\n\ny", 4), (3, texts[2][1], 0), (4, "z", 6), (5, "", 4), (5, "", 4)]


# --- fingerprints


def plain_sketch(text, fraction=fingerprints.FRACTION, floor=fingerprints.FLOOR):
    words = text.lower().split()
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    hashes = set()
    for k in range(max(len(words) - 4, 1) if words else 0):
        h = 42
        for w in words[k : k + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        hashes.add(signed(h))
    t = int(-(2**63) + fraction * 2**64)
    low = sorted(h for h in hashes if h < t)
    if len(low) >= floor:
        return t, low
    every = sorted(hashes)
    return (2**63 - 1, every) if len(every) <= floor else (every[floor - 1] + 1, every[:floor])


def plain_near(x, y):
    bound = min(x[0], y[0])
    a, b = ({h for h in s[1] if h < bound} for s in (x, y))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_a_plain_version(spark):
    texts = [(k * 7, prose(k, 5 * (k % 40)) if k % 9 else prose(3, 300) + " é😀") for k in range(60)] + [(1000, None), (1001, ""), (1002, prose(1, 3000))]
    out = fingerprints.fingerprint_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == [k for k, _ in texts]
    texts = [(k, t or "") for k, t in texts]
    for n, r in enumerate(out):
        text, following = texts[n][1], texts[(n + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, nxt = map(plain_sketch, (text, edited, following))
        show = lambda s: f"{s[0] % 2**64:016X}:" + "".join(f"{h % 2**64:016X}" for h in s[1])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (show(own), show(other))
        assert r.near_edited == pytest.approx(plain_near(own, other)) and r.near_next == pytest.approx(plain_near(own, nxt))


def test_runs_cover_every_pair_of_neighbours(spark):
    df = spark.range(1000).selectExpr("id * 3 AS doc_id", "concat('t', id) AS text")
    runs = fingerprints.in_runs(df, "doc_id", run_rows=50).cache()
    assert runs.where("NOT after").count() == 1000 and runs.where("after").count() == runs.select("run").distinct().count() >= 15
    out = fingerprints.fingerprint_documents(df).count()
    assert out == 1000


@pytest.mark.parametrize("ids", ["CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id END", "concat('document-', id % 400)", "CASE WHEN id % 2 = 0 THEN concat('x', id) END", "1152921504606846976 + id"])
def test_runs_of_any_ids_follow_each_other(spark, monkeypatch, ids):
    """Null ids, an id of a third of the rows, ids as text, ids that a double can't tell apart: as many runs, and the neighbours of one sort."""
    monkeypatch.setattr(fingerprints, "RUN_ROWS", 50)
    df = spark.range(1500).selectExpr(f"{ids} AS doc_id", "concat('w', id, ' a b c d e ', id * 7) AS text")
    runs = fingerprints.in_runs(df, "doc_id", run_rows=50)
    sizes = [r["count"] for r in runs.where("NOT after").groupBy("run").count().collect()]
    assert sum(sizes) == 1500 and (max(sizes) < 400 or "1152" in ids)
    order = runs.where("NOT after").select("doc_id", "text", "h", "run").collect()
    order.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0 if not isinstance(r.doc_id, str) else r.doc_id, r.h))
    assert [r.run for r in order] == sorted(r.run for r in order)
    out = fingerprints.fingerprint_documents(df).collect()
    edited = lambda x, y: x[: len(x) - len(x) // 2] + y[: len(x) // 2]
    expected = sorted(hashlib.sha256(edited(r.text, s.text).encode()).hexdigest() for r, s in zip(order, order[1:] + order[:1], strict=True))
    assert sorted(r.edited_sha256 for r in out) == expected


def test_sketch_with_and_without_a_floor(spark):
    """Long texts alike; of short ones the plain sketch may hold nothing, and then no likeness is told."""
    rows = [(prose(1, 3000), prose(1, 2400)), ("a b c", "a b d"), ("", ""), ("", "a b")]
    df = spark.createDataFrame(rows, "x string, y string")
    for floor in (0, fingerprints.FLOOR):
        made = fingerprints.sketch(fingerprints.sketch(df, F.col("x"), "p", floor=floor), F.col("y"), "q", floor=floor)
        near = [r.near for r in made.select(fingerprints.likeness(F.col("p"), F.col("q")).alias("near")).collect()]
        assert near[0] == pytest.approx(0.8, abs=0.06) and near[2] == 1.0
        assert (near[1], near[3]) == ((0.0, 0.0) if floor else (None, None)) or not floor and set(near[1:]) <= {None, 0.0, 1.0}
    long = fingerprints.sketch(df.where("length(x) > 9"), F.col("x"), "p").first().p
    assert len(long.hashes) / 2996 == pytest.approx(fingerprints.FRACTION, abs=0.03)


def test_fingerprints_odd_cases(spark):
    df, rows = odd_documents(spark, extra=True)
    out = fingerprints.fingerprint_documents(df).collect()
    assert len(out) == len(rows)
    assert len({r.fingerprint for r in out if r.doc_id in (0, 1, None) and r.n_chars > 5}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert fingerprints.fingerprint_documents(empty_documents(spark)).count() == 0
    lone = fingerprints.fingerprint_documents(df.where("doc_id = 0")).first()
    assert lone.near_next == 1.0


def test_sketch_estimates(spark):
    a, b = prose(5, 4000, 10**6).split(), prose(6, 4000, 10**6).split()
    df = spark.createDataFrame([(" ".join(a), " ".join(a[:2000] + b[:2000]), " ".join(a[:400]))], "x string, y string, z string")
    df = fingerprints.sketch(fingerprints.sketch(fingerprints.sketch(df, F.col("x"), "p"), F.col("y"), "q"), F.col("z"), "s")
    r = df.select(fingerprints.likeness(F.col("p"), F.col("q")).alias("near"), fingerprints.containment(F.col("s"), F.col("p")).alias("inside"), fingerprints.merge(F.col("p"), F.col("q")).alias("m"), "p", "q").first()
    assert r.near == pytest.approx(1 / 3, abs=0.06) and r.inside == 1.0
    assert set(r.m.hashes) == set(r.p.hashes) | set(r.q.hashes)


def test_native_plans_have_no_python(spark, data):
    for name in ("op4_scaled_sketch", "op6_bernoulli_mixing", "op7_window_line_dedup", "op10_tree_sharding"):
        plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), name
    assert SCHEMA


def test_containment_is_null_where_nothing_can_be_told(spark):
    long = " ".join(f"x{k}" for k in range(4000))
    rows = [(k, f"a{k} b{k} c{k}", long) for k in range(200)] + [(200, "", long), (201, "", ""), (202, long, long)]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    df = fingerprints.sketch(fingerprints.sketch(df, F.col("a"), "p", floor=fingerprints.FLOOR), F.col("b"), "q", floor=fingerprints.FLOOR)
    found = {r.k: r.inside for r in df.select("k", fingerprints.containment(F.col("p"), F.col("q")).alias("inside")).collect()}
    assert {found[k] for k in range(200)} == {None, 0.0} and found[200] == found[201] == found[202] == 1.0
