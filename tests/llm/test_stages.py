"""Each stage of the pipeline, and the classifier's score, against a plain version of it in Python."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from llm.helpers import prose
from llm.test_free import plain_join

from substrata.llm import decontam, mixing, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def draw(*parts):
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13


def plain_score(model, text):
    """By all labellings of the lines: each line's chance to be good, their mean by length, and the logistic fit."""
    document, x, length = quality.measure([text])
    if not len(document):
        return 1 / (1 + math.exp(-model.shift))
    rows = np.clip((x - model.mean) / model.scale, -4, 4)
    none = np.zeros_like(rows[0])
    emission = [np.concatenate([rows[k], rows[k - 1] if k else none, rows[k + 1] if k + 1 < len(rows) else none, [1.0]]) @ model.weights for k in range(len(rows))]
    good, whole = np.zeros(len(rows)), 0.0
    for y in itertools.product((0, 1), repeat=len(rows)):
        weight = math.exp(sum(e * v for e, v in zip(emission, y, strict=True)) + sum(model.link[a, b] for a, b in itertools.pairwise(y)))
        whole += weight
        good += weight * np.array(y)
    share = min(max(float((good / whole * length).sum() / length.sum()), 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(model.slope * math.log(share / (1 - share)) + model.shift)))


def documents():
    r = random.Random(12)
    rows = []
    for k in range(150):
        if k % 5 == 4:
            text = "\n".join("$$ WIN | CASH | NOW !!! " + str(r.randrange(10**6)) for _ in range(r.randint(1, 8)))
        elif k % 7 == 3:
            text = rows[k - 3][1]
        elif k % 7 == 5:
            words = rows[k - 5][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        else:
            text = "\n".join("The " + prose(1000 * k + j, r.randint(5, 30), 5000) + "." for j in range(r.randint(1, 8)))
        rows.append((k, text, "en", f"s{k % 4}" if k % 11 else None, len(text)))
    return rows + [(150, None, "en", "s1", None), (151, "", "en", "s1", 0), (152, " \n ", "en", "s0", 3)]


def test_document_scores_by_all_labellings(spark):
    rows = documents()
    labels = spark.createDataFrame([(k, int("WIN" not in t)) for k, t, *_ in rows[:150]], "doc_id long, quality int")
    model = quality.train(spark.createDataFrame(rows, SCHEMA), labels)
    out = {r.doc_id: r.score for r in quality.score_documents(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert out == pytest.approx({k: plain_score(model, t) for k, t, *_ in rows}, abs=1e-6)


def test_long_labelled_documents_are_fitted_to(spark):
    """Documents of more lines than the fit takes are in it by a run of lines."""
    rows = [(k, "\n".join(("$$ | !! 99 " if k % 2 else "The words of a line, and more. ") + prose(k * 1000 + j, 4) for j in range(500)), "en", "s", 1) for k in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = quality.train(docs, spark.createDataFrame([(k, 1 - k % 2) for k in range(12)], "doc_id long, quality int"))
    assert {r.doc_id: r.predicted for r in quality.score_documents(docs, model).collect()} == {k: 1 - k % 2 for k in range(12)}


def plain_clean(text, items, window):
    """The text without hit words and what stands between them, again and again; None if more than half of it is hit at first."""
    first = True
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(x.lower() if "A" <= x <= "Z" else x for x in t or "")
    grams = collections.defaultdict(set)
    for item in items:
        w = word.findall(lower(item))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams[n].add(tuple(w[k : k + n]))
    while True:
        found = list(word.finditer(lower(text)))
        hit = set()
        for n, known in grams.items():
            for k in range(len(found) - n + 1):
                if tuple(m.group() for m in found[k : k + n]) in known:
                    hit |= set(range(k, k + n))
        if first and len(hit) > 0.5 * len(found):
            return False, None
        first = False
        if not hit:
            return True, text
        gone = set()
        for k in hit:
            gone |= set(range(found[k].start(), found[k].end()))
            if k + 1 in hit:
                gone |= set(range(found[k].end(), found[k + 1].start()))
        text = "".join(x for i, x in enumerate(text) if i not in gone)


def plain_mix(rows):
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t, *_ in rows}
    total = collections.Counter()
    for k, _, _, s, _ in rows:
        total[s] += size[k]
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    while True:
        free = [s for s in names if s not in capped]
        left = sum(total.values()) - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        if not over:
            break
        capped |= {s: 3.0 * total[s] for s in over}
    target, copies = capped | share, {}
    for s in names:
        mine = [k for k, _, _, x, _ in rows if x == s]
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        need, bins, limit, so_far = target[s] - whole * total[s], collections.Counter(), 0, 0
        for k in mine:
            bins[int(draw("mix", k) * mixing.BINS)] += size[k]
        for b in sorted(bins):
            so_far += bins[b]
            if bins[b] and need > 0 and so_far - bins[b] / 2 <= need:
                limit = b + 1
        copies |= {k: whole + (draw("mix", k) * mixing.BINS < limit) for k in mine}
    return copies


def plain_place(tree, key):
    path = "tree"
    while isinstance(tree, dict):
        weights = sharding._weights(tree)
        child = min(sorted(weights), key=lambda c: -math.log(draw(f"{path}/{c}", key)) / weights[c])
        tree, path = tree[child], f"{path}/{child}"
    return tuple(map(int, path.split("/")[1:]))


def test_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline

    rows = documents()
    items = [rows[1][1].replace("\n", " "), "the changed word", prose(1000 * 8, 20, 5000), None, ""]
    long = next(t for k, t, *_ in rows[6:] if t and len(t.split()) > 60 and "WIN" not in t)
    items.append(" ".join(long.split()[5:25]))
    tables = {"labels": spark.createDataFrame([(k, int("WIN" not in t), 0) for k, t, *_ in rows[:150]], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string"), "documents": spark.createDataFrame(rows, SCHEMA).repartition(3)}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, tables["labels"])
    key = lambda r: (r[0], str(r))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = sorted(map(tuple, docs.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=key)
        if name == "quality":
            rows = [r for r in rows if plain_score(model, r[1]) >= quality.THRESHOLD]
            assert 100 < len(rows) < 140
        elif name == "near_duplicates":
            classes = plain_join([(r[0], r[1] or "") for r in rows])
            rows = [r for r in rows if classes[r[0]][0] == r[0]]
        elif name == "decontamination":
            found = [(r, *plain_clean(r[1], items, decontam.WINDOW_WORDS)) for r in rows]
            assert sum(not kept for _, kept, _ in found) >= 1 and sum(kept and t != r[1] for r, kept, t in found) >= 1
            rows = [(r[0], t, r[2], r[3], None if t is None else len(t)) for r, kept, t in found if kept]
        elif name == "mixing":
            copies = plain_mix(rows)
            rows = [r for r in rows for _ in range(copies[r[0]])]
        assert got == sorted(rows, key=key), name
    tree = sharding.Topology.even(corpus_pipeline.SHARDS).tree()
    placed = docs.collect()
    assert all((r.region, r.rack, r.shard) == plain_place(tree, r.doc_id) for r in placed)
    slots = collections.defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
