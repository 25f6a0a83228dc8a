"""Decontamination, WARC, HTML, quality, language model, n-gram join and the pipeline."""

import base64
import collections
import gzip
import hashlib
import html
import io
import itertools
import pickle
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import SCHEMA, empty_documents, odd_documents, prose
from pyspark.sql import functions as F

from substrata.llm import components, decontam, html_extract, lm_score, ngram_join, queries, quality, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- decontamination


def plain_scan(text, items, window):
    lower = lambda t: "".join(x.lower() if "A" <= x <= "Z" else x for x in t or "")
    words, hit, names = WORD.findall(lower(text)), set(), set()
    for name, item in items:
        w = WORD.findall(lower(item))
        n = min(window, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for k in range(len(words) - n + 1 if w else 0):
            if tuple(words[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                names.add(str(name))
    return len(words), hit, sorted(names)


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_a_plain_search(seed):
    r = random.Random(seed)
    items = [(k, " ".join(r.choice("abcé") for _ in range(r.choice([0, 1, 2, 3, 6, 12, 12])))) for k in range(8)] + [(8, "a b c"), (9, "a b c")]
    coded = [(str(n), decontam.words(t)) for n, t in items]
    automaton = decontam.Automaton([c for c in coded if c[1]], 4)
    for _ in range(30):
        text = " ".join(r.choice("abcéx") for _ in range(r.randint(0, 40)))
        n, hit, names = plain_scan(text, items, 4)
        spans, found = automaton.scan(decontam.words(text))
        assert len(decontam.words(text)) == n
        assert set(itertools.chain.from_iterable(range(*s) for s in spans)) == hit
        assert sorted({automaton.names[k] for k in found}) == names


def test_automaton_scans_in_time_and_stays_small():
    """Items and texts of one repeated word, where each word has as many suffixes as words before it; a short item inside."""
    items = [("one", [b"a"] * 30_000), ("short", [b"a"] * 3), ("b", [b"b", b"a"])]
    automaton = pickle.loads(pickle.dumps(decontam.Automaton(items)))
    began = time.time()
    spans, hit = automaton.scan([b"a"] * 300_000 + [b"b", b"a", b"c"])
    assert time.time() - began < 5 and spans == [(0, 300_002)] and hit == {0, 1, 2}
    r = random.Random(3)
    big = decontam.Automaton([(str(k), [b"w%d" % r.randrange(30_000) for _ in range(50)]) for k in range(2000)])
    assert big.nbytes < 100 * 50 * 2000


def test_scan_with_several_automata(spark):
    """A benchmark of more words than one automaton takes gives the rows that one of all items gives."""
    r = random.Random(6)
    items = [(k, " ".join(r.choice("abcdef") for _ in range(r.choice([2, 5, 11, 14])))) for k in range(12)] + [(3, "a b"), (None, "c d e")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k % 30, " ".join(r.choice("abcdefxyz") for _ in range(r.randrange(60)))) for k in range(40)] + [(None, None), (50, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("odd")).withColumn("n_hit", F.lit(7)).repartition(3)
    one, several = (sorted(map(str, decontam.scan_documents(docs, bench, window=4, block_words=n).collect())) for n in (1000, 20))
    assert one == several and any("contaminated=True" in x for x in one)
    one, several = (sorted(map(str, decontam.decontaminate(docs, bench, window=4, max_coverage=0.3, block_words=n).collect())) for n in (1000, 20))
    assert one == several and len(one) < len(rows)


def test_words_follow_the_pattern():
    text = "".join(map(chr, range(256))) + " AZ É日本 a b 😀x 0-9_"
    lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text)
    assert [w.decode() for w in decontam.words(text)] == WORD.findall(lower)


def test_scan_and_cut(spark):
    p = prose(77, 30, 10**6)
    bench = spark.createDataFrame([(1, p), (2, "tiny item"), (3, None), (4, "..."), (2, "tiny item")], "item_id long, text string")
    rows = [(1, f"Clean start, {p.upper()}! And clean end."), (2, p), (3, "just a TINY, item here among many other words"), (4, "clean " * 20), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("odd"))
    out = {r.doc_id: r for r in decontam.scan_documents(docs, bench).collect()}
    assert [(out[k].n_hit, out[k].n_items) for k in range(1, 7)] == [(30, 1), (30, 1), (2, 1), (0, 0), (0, 0), (0, 0)]
    assert out[1].spans == [[2, 32]] and out[4].items_sha256 == hashlib.sha256(b"").hexdigest()
    kept = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, max_coverage=0.9).collect()}
    assert set(kept) == {1, 3, 4, 5, 6}
    assert kept[1] == "Clean start, ! And clean end." and kept[3] == "just a  here among many other words" and kept[4] == rows[3][1] and kept[5] is None
    again = decontam.scan_documents(decontam.decontaminate(docs, bench), bench)
    assert again.where("contaminated").count() == 0
    assert decontam.scan_documents(empty_documents(spark), bench).count() == 0
    assert decontam.scan_documents(docs, bench.where("item_id = 3")).where("contaminated").count() == 0
    odd, rows = odd_documents(spark, extra=True)
    assert decontam.scan_documents(odd, bench).count() == decontam.decontaminate(odd, bench).count() == len(rows)


# --- WARC


def pages(spark, extra=False):
    big = "<p>" + "ab\r\n\r\nWARC/1.1\r\n" * 50_000
    rows = [(1, "http://a/ x\r\ny", "<p>é</p>"), (2, None, None), (3, "http://b/", ""), (4, "http://a/", "<p>é</p>"), (5, "u", big), (None, "u", "<p>é</p>"), (4, "http://a/", "<p>é</p>"), (7, "u", big), (8, "u", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return (df.withColumn("keeper", F.lit("odd")).withColumn("payload", F.lit(1)) if extra else df), rows


def test_warc_round_trip(spark, tmp_path):
    df, rows = pages(spark, extra=True)
    files = warc.write_archives(df.repartition(3), f"file://{tmp_path}/w", chunk_bytes=1000)
    table = warc.read_archives(files, chunk_bytes=777).collect()
    by_record = {}
    for r in table:
        by_record.setdefault((r.page_id, r.record_type, r.record_id), []).append(r)
    ends = [r for r in table if r["last"]]
    assert len(ends) == len(rows) and all(r.intact for r in ends)
    got = {(r.page_id, r.record_type, r.refers_to): (r.payload_bytes, r.payload_digest) for r in ends}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    kinds = {(1, "revisit", 4): "<p>é</p>", (2, "revisit", 3): "", (3, "response", None): "", (4, "response", None): "<p>é</p>", (5, "revisit", 7): rows[4][2], (None, "revisit", 4): "<p>é</p>", (7, "response", None): rows[4][2], (8, "response", None): rows[8][2]}
    assert got == {k: (len(t.encode()), digest(t)) for k, t in kinds.items()}
    seven = sorted((r for r in table if r.page_id == 7), key=lambda r: r.chunk_no)
    assert b"".join(r.chunk for r in seven) == rows[7][2].encode() and len(seven) > 100
    so_far = hashlib.sha1()
    for r in seven:
        so_far.update(r.chunk)
        assert r.sha1_so_far == so_far.hexdigest()
    small = warc.write_archives(df, f"file://{tmp_path}/v", min_bytes=5)
    assert warc.read_archives(small).where("last AND payload_bytes = 0 AND record_type = 'response'").count() == 2
    for r in files.collect():  # another reader: whole members of gzip
        data = gzip.decompress(open(r.path.removeprefix("file://"), "rb").read())
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_warc_of_nothing_and_torn_archives(spark, tmp_path):
    df, _ = pages(spark)
    files = warc.write_archives(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(files).count() == 0
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc.parse_records(io.BytesIO(b"junk\r\n")))
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:AAAA\r\nX-Payload-Length: 3\r\nContent-Length: 8\r\n\r\nH\r\n\r\nab"
    assert [r["intact"] for r in warc.parse_records(io.BytesIO(one))] == [None, False]


# --- HTML


def test_extraction_of_articles():
    page = html_extract.Page(
        """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="sidebar"><header><h1>Site</h1></header><nav><a href=x>menu</a></nav><div id="cookieNotice">We use cookies</div>
        <div class="wrap"><div class="post-12 post-body"><h2>Title</h2><p>One <a href="x">li<b>nk</b></a>\n two&nbsp;&lt;b&gt; &#233;&amp;amp;</p><form>Mail<input value="a>b"><button>Go</button></form><ul><li>point<li>other</ul>
        <!-- <p>no</p> --><blockquote>quote</blockquote><div class="comments"><p>reader says a lot of things here and there</p></div><div class="ad">buy</div></div><aside>side</aside></div><footer>foot</footer><script>if(a<b)"</p>"</script><p clas"""
    )
    assert page.text() == "Title\nOne link two <b> é&amp;\npoint\nother\nquote"
    listed = html_extract.Page('<article class="post category-social"><h1>T</h1><p class="advert">buy<p>text one<ul><li class="share">x<p>y</p><li>item</ul><article class="comment odd">says</article><blockquote class="ad">no</blockquote><p>end</article><article class="comment">more words here than in all of the article</article>')
    assert listed.text() == "T\ntext one\nitem\nend"
    plain = [("", ""), ("a < b & c", "a < b & c"), ("<p>a<p>b<b>c</b>d", "a\nbcd"), ("<div><div><p>" * 50 + "deep", "deep"), ("</div></p>x", "x"), ("<script>never ends", "")]
    assert [html_extract.Page(h).text() for h, _ in plain] == [t for _, t in plain]


@pytest.mark.parametrize("name,aside", [("comment-body", True), ("page-header", True), ("entry-header", False), ("post-content", False), ("content-with-sidebar", False), ("mainNav", True), ("article_comments", True), ("cookie-notice", True), ("ad", True), ("add-on", False), ("text-ad", True), ("no-ads", False), ("shadow", False), ("site-footer-inner", True), ("adBox2", True), ("c12", False)])
def test_names_beside_the_article(name, aside):
    prose, found, _ = html_extract.Page._names(f' id=x class="{name}"')
    assert found == aside
    if not prose:
        page = html_extract.Page(f'<div><p>here</p><div class="{name}"><p>inner text</p></div></div>')
        assert page.text() == ("here" if aside else "here\ninner text")


def test_extraction_follows_the_host(spark):
    body = lambda k: f'<html><body><div class="top-{k}">{"menu " * 3}</div><div class="c{k}"><p>{prose(k, 60)}</p><p>{prose(k + 50, 40)}</p></div><div class="foo">tail text {k}</div></body></html>'
    odd = '<html><body><div class="c5"><p>short note</p></div><div class="foo">' + "tail " * 80 + "</div></body></html>"
    rows = [(k, "https://user@Host.example:80/x", body(k)) for k in range(8)] + [(8, "http://host.example/y", odd), (9, None, None), (10, "nonsense", ""), (0, "https://host.example/x", body(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("odd"))
    votes = html_extract.winners(html_extract.host_votes(df)).collect()
    assert {r.host: r.path for r in votes}["host.example"] == "/html/body/div.c#"
    out = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert all(out[k].text == f"{prose(k, 60)}\n{prose(k + 50, 40)}" for k in range(8))
    assert out[9].text == "" and out[10].n_chars == 0 and out[8].text == "short note\n" + " ".join(["tail"] * 80)  # the host's path holds next to nothing there, so the best container is taken too
    assert html_extract.extract(df).count() == len(rows) and html_extract.extract(df.limit(0)).count() == 0


def test_extraction_of_split_articles(spark):
    """A page whose article stands in two containers loses neither, whatever its host's path; a host's path stands alone where it holds the article."""
    usual = lambda k: f'<html><body><div class="main-a"><p>{prose(k, 90)}</p></div><div class="extra"><p>few words</p></div></body></html>'
    split = f'<html><body><div class="main-a"><p>{prose(70, 40)}</p></div><div class="part2"><p>{prose(71, 80)}</p></div></body></html>'
    rows = [(k, "http://h.example/", usual(k)) for k in range(6)] + [(6, "http://h.example/s", split)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[6] == f"{prose(70, 40)}\n{prose(71, 80)}" and all(out[k] == prose(k, 90) for k in range(6))
    titled = html_extract.Page(f'<html><body><div class="post"><h1>Title</h1><p>Lead</p><div class="post-body"><p>{prose(3, 99)}</p></div></div></body></html>')
    assert titled.text() == f"Title\nLead\n{prose(3, 99)}"


def test_extraction_keeps_blocks_named_by_their_headings():
    page = html_extract.Page(
        '<article><h2 id="search-algorithms">Search</h2><p id="related-work">Work</p><p class="reply-count">Count</p><section id="related-work"><p>deep <math><mi>x</mi></math> <object>o</object></p></section>'
        '<p>before <svg viewBox="a/>b"/> after<svg><text>no</text></svg></p><select><option>no</select><p class="newsletter-signup">no</p><section id="comments"><p>no</p></section><script src="x"/>if(no)</script></article>'
    )
    assert page.text() == "Search\nWork\nCount\ndeep x o\nbefore after"


@pytest.mark.parametrize("start,unit", [("<script", "\"'"), ("<svg ", "\"'"), ("<div ", "\"'"), ("", "<div>"), ("<script>", "</script "), ("", "<a \"<a >\""), ("", "<!--"), ("", "<svg/"), ("", "<"), ("", "&"), ("", "<td><tr>"), ("", "<a '\"><b "), ("", "<article><p class=ad>")])
def test_extraction_reads_hostile_markup_in_time(start, unit):
    began = time.time()
    page = html_extract.Page(start + unit * 40_000 + "x")
    page.votes()
    page.text()
    assert time.time() - began < 20


def test_extraction_of_a_very_long_page():
    words = [prose(k, 50) for k in range(4000)]
    page = html_extract.Page("<body><nav>menu</nav><div class=post>" + "".join(f"<p>{w}</p>" for w in words) + "</div></body>")
    assert page.text() == "\n".join(words) and max(map(len, page.votes())) < 40


def test_extraction_of_the_test_pages(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet").join(queries.QUERIES["op2_host_paths"](spark, data).select("page_id", "text", "n_chars"), "page_id").collect()
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# --- quality


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(0)
    document = np.array([0, 0, 0, 1, 2, 2])
    emission, link = rng.normal(size=6), rng.normal(size=(2, 2))
    marginal, links, partition = quality.forward_backward(emission, link, quality.Chains.of(document))
    expected, pairs = np.zeros((6, 2)), np.zeros((2, 2))
    for k in range(3):
        rows = np.flatnonzero(document == k)
        scores = {}
        for y in itertools.product((0, 1), repeat=len(rows)):
            scores[y] = np.exp(sum(emission[r] * v for r, v in zip(rows, y, strict=True)) + sum(link[a, b] for a, b in itertools.pairwise(y)))
        z = sum(scores.values())
        for y, s in scores.items():
            for r, v in zip(rows, y, strict=True):
                expected[r, v] += s / z
            for a, b in itertools.pairwise(y):
                pairs[a, b] += s / z
    assert marginal == pytest.approx(expected) and links == pytest.approx(pairs) and len(partition) == 3


def test_measures_of_lines():
    document, x, length = quality.measure(["One line.\n\n  \nTWO LINES!! é", None, "", "x"])
    assert document.tolist() == [0, 0, 3] and length.tolist() == [9, 13, 1]
    at = quality.MEASURES.index
    assert x[1, at("upper")] == pytest.approx(1) and x[1, at("shouts")] == pytest.approx(2 / 3) and x[0, at("ends")] == 1


def test_quality_holds_out_and_separates(spark, data):
    out = queries.QUERIES["op1_line_crf"](spark, data).toPandas()
    import zlib

    assert (out.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in out.doc_id]).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas().merge(out, on="doc_id")
    held = labels[labels.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.9


def test_quality_odd_cases(spark):
    df, rows = odd_documents(spark, extra=True)
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (6, None, None), (None, 1, 1), (2, 0, 0), (8, 1, 0), (7, 0, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality.train(df, table)
        out = quality.score_documents(df, model).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id in (3, 4, 5)}) == 1
        kept = quality.keep_good(df, model)
        assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in out)
    assert quality.score_documents(empty_documents(spark), model).count() == 0


# --- language model


def test_language_model(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    words = lm_score.vocabulary(docs)
    texts = lm_score.coded(docs, words).cache()
    network = lm_score.train(texts, words)
    found = lm_score.scores(texts, words, network).toPandas()
    start = lm_score.scores(texts, words, lm_score.Network.start(words.counts)).toPandas()
    assert found.log_likelihood.sum() > start.log_likelihood.sum()
    assert found.n_words.tolist() == [len(lm_score.split(t)) for t in docs.toPandas().text]


def plain_log_probability(network, codes, at):
    """Of the class at one place, by the definition: its group, and the class in the group."""
    around = np.concatenate([network.embed[codes[at + k]] for k in (-2, -1, 1, 2)]).astype(float)
    h = np.tanh(around @ network.w1 + network.b1)
    log_softmax = lambda x: x - np.log(np.exp(x).sum())
    group, member = divmod(int(codes[at]), lm_score.MEMBERS)
    return log_softmax(h @ network.wg + network.bg)[group] + log_softmax(h @ network.wm[group] + network.bm[group])[member]


def test_language_model_against_a_plain_scorer(spark):
    """Places one by one, and whole documents: the classes' log-probabilities and the words' shares of their classes."""
    drawn = np.random.default_rng(4)
    network = lm_score.Network(drawn.normal(0, 0.4, lm_score._SIZE))
    codes, at = drawn.integers(0, lm_score._CLASSES, 300).astype(np.int16), np.arange(2, 298)
    assert network.log_probabilities(codes, at) == pytest.approx([plain_log_probability(network, codes, k) for k in at], abs=2e-4)
    r = random.Random(9)
    texts = [" ".join(f"v{int(4000 * r.random() ** 3)}" for _ in range(r.choice([0, 1, 2, 5, 30]))) for _ in range(900)] + [None, ""]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    words = lm_score.vocabulary(docs)
    counts = collections.Counter(w for t in texts for w in lm_score.split(t))
    by_count, own = sorted(counts, key=lambda w: (-counts[w], w)), lm_score._CLASSES - lm_score.RARE
    assert len(by_count) > own + 500
    code = {w: k if k < own else lm_score._rare(w) for k, w in enumerate(by_count)}
    total = collections.Counter()
    for w, n in counts.items():
        total[code[w]] += n
    coded = lm_score.coded(docs, words)
    found = {x.doc_id: x.log_likelihood for x in lm_score.with_shares(lm_score.scores(coded, words, network), coded, words).collect()}
    for k, t in enumerate(texts):
        run = lm_score.split(t)
        padded = np.array([lm_score._PAD] * 2 + [code[w] for w in run] + [lm_score._PAD] * 2)
        assert found[k] == pytest.approx(sum(plain_log_probability(network, padded, i + 2) + np.log(counts[w] / total[code[w]]) for i, w in enumerate(run)), abs=1e-2)


def test_language_model_is_a_distribution():
    """The probabilities of all classes at a place, given its neighbours, add up to 1."""
    network = lm_score.Network(np.random.default_rng(1).normal(0, 0.5, lm_score._SIZE))
    classes = lm_score.GROUPS * lm_score.MEMBERS
    codes = np.tile(np.array([3, 9, 0, 700, 5], np.int16), classes)
    places = np.arange(classes) * 5 + 2
    codes[places] = np.arange(classes)
    assert np.exp(network.log_probabilities(codes, places).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_language_model_training_follows_the_slope():
    words = lm_score.Vocabulary(lm_score.Codes(), np.zeros(1024), np.ones(1024))
    network = lm_score.Network.start(words.counts)
    codes = np.array([lm_score._PAD] * 2 + [1, 2, 3, 4] * 50 + [lm_score._PAD] * 2, np.int16)
    at = np.arange(2, 202)
    before = network.log_probabilities(codes, at).mean()
    memory = np.full(lm_score._SIZE, 1e-4, np.float32)
    for _ in range(150):
        network.train(codes, at, memory)
    assert network.log_probabilities(codes, at).mean() > before + 3


def test_language_model_slopes_are_the_numeric_ones():
    """A step with a large, even memory moves the weights by their slopes."""
    drawn = np.random.default_rng(3)
    network = lm_score.Network(drawn.normal(0, 0.3, lm_score._SIZE))
    codes, at = drawn.integers(0, lm_score._CLASSES, 3000).astype(np.int16), np.arange(2, 2998)
    flat = network.flat.copy()
    network.train(codes, at, np.full(lm_score._SIZE, 1e12, np.float32), 1e6)
    slope = (flat - network.flat).astype(float)
    loss = lambda f: -lm_score.Network(f).log_probabilities(codes, at).astype(float).mean()
    ends = np.cumsum([0, *(int(np.prod(s)) for s in lm_score._SHAPES.values())])
    for a, b in itertools.pairwise(ends):
        way = np.zeros(lm_score._SIZE)
        way[a:b] = slope[a:b] / np.linalg.norm(slope[a:b])
        numeric = (loss(flat + 0.02 * way) - loss(flat - 0.02 * way)) / 0.04
        assert numeric == pytest.approx(np.linalg.norm(slope[a:b]), rel=0.03)


def plain_step(w, memory, codes, at):
    """A step of Adagrad, statement by statement: each table's slopes by themselves, groups put in order and back, embeddings' slopes column by column."""
    n, side = np.float32(len(at)), np.arange(len(at))
    around = np.stack([codes[at + k] for k in (-2, -1, 1, 2)], 1)
    joined = w["embed"].take(around, axis=0).reshape(len(at), -1)
    h = np.tanh(joined @ w["w1"] + w["b1"])
    group, member = np.divmod(codes[at], lm_score.MEMBERS)
    slopes = {k: np.zeros_like(v) for k, v in w.items()}

    def errors(logits, right):
        p = np.exp(np.minimum(logits, 60))
        p /= p.sum(1, keepdims=True)
        p[side, right] -= 1
        return p / n

    p = errors(h @ w["wg"] + w["bg"], group)
    slopes["wg"], slopes["bg"], back = h.T @ p, p.sum(0), p @ w["wg"].T
    order = np.argsort(group, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=lm_score.GROUPS))]).tolist()
    sorted_h, logits = h[order], w["bm"][group[order]]
    for g, (a, b) in enumerate(itertools.pairwise(ends)):
        logits[a:b] += sorted_h[a:b] @ w["wm"][g]
    p, more = errors(logits, member[order]), np.empty_like(h)
    for g, (a, b) in enumerate(itertools.pairwise(ends)):
        slopes["wm"][g], slopes["bm"][g], more[a:b] = sorted_h[a:b].T @ p[a:b], p[a:b].sum(0), p[a:b] @ w["wm"][g].T
    back[order] += more
    back *= 1 - h * h
    slopes["w1"], slopes["b1"] = joined.T @ back, back.sum(0)
    parts = (back @ w["w1"].T).reshape(-1, lm_score.EMBEDDING)
    for k in range(lm_score.EMBEDDING):
        slopes["embed"][:, k] = np.bincount(around.ravel(), parts[:, k], len(w["embed"]))
    for k, slope in slopes.items():
        memory[k] += slope * slope
        w[k] -= np.float32(lm_score.RATE) * slope / (np.sqrt(memory[k]) + np.float32(1e-6))


def test_language_model_steps_are_the_plain_ones_in_less_time():
    """Steps on Zipf's words leave the weights where plain steps leave them, in less CPU time (the least of many, in turns)."""
    drawn = np.random.default_rng(6)
    codes = np.minimum(drawn.zipf(1.15, 60_000) - 1, lm_score._CLASSES - 1).astype(np.int16)
    codes[::97] = lm_score._PAD
    network = lm_score.Network.start(np.bincount(codes, minlength=lm_score._CLASSES)[: lm_score._CLASSES].astype(float))
    plain = {k: getattr(network, k).copy() for k in ("embed", "w1", "b1", "wg", "bg", "wm", "bm")}
    memory, memories = np.full(lm_score._SIZE, 1e-4, np.float32), {k: np.full_like(v, 1e-4) for k, v in plain.items()}
    places = drawn.permutation(np.flatnonzero(codes < lm_score._PAD)[2:-2])
    took, plain_took = [], []
    for k in range(0, 50 * lm_score.BATCH, lm_score.BATCH):
        at = places[k : k + lm_score.BATCH]
        began = time.thread_time()
        network.train(codes, at, memory)
        between = time.thread_time()
        plain_step(plain, memories, codes, at)
        took.append(between - began)
        plain_took.append(time.thread_time() - between)
    for k, v in plain.items():
        assert getattr(network, k) == pytest.approx(v, abs=2e-5), k
    assert min(took) < 0.8 * min(plain_took)


def test_language_model_steps_without_some_groups():
    """A group that has no target in a batch keeps its weights, also when it had some in the batch before."""
    network = lm_score.Network(np.random.default_rng(8).normal(0, 0.3, lm_score._SIZE))
    memory = np.full(lm_score._SIZE, 1e-4, np.float32)
    codes = np.array([lm_score._PAD] * 2 + [1, 40, 70, 1023] * 50 + [lm_score._PAD] * 2, np.int16)
    network.train(codes, np.arange(2, 202), memory)
    weights = network.wm.copy()
    network.train(codes, np.arange(2, 202, 4), memory)
    assert [g for g in range(lm_score.GROUPS) if not np.array_equal(network.wm[g], weights[g])] == [0]


def test_language_model_scores_hardly_depend_on_the_tasks(spark, data):
    """Trained in one task and in eight, documents stand in nearly the same order."""
    docs, ranks = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), []
    for n in (1, 8):
        out = lm_score.score_documents(docs.repartition(n, "doc_id")).toPandas().set_index("doc_id").mean_log_likelihood.dropna()
        ranks.append(out.rank())
    assert ranks[0].corr(ranks[1].reindex(ranks[0].index)) > 0.97


def test_language_model_scores_shuffled_texts_lower(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    words = lm_score.vocabulary(docs)
    network = lm_score.train(lm_score.coded(docs, words).cache(), words)
    shuffle, rows = random.Random(5), []
    for k, t in enumerate(docs.toPandas().text):
        shuffled = lm_score.split(t)
        shuffle.shuffle(shuffled)
        rows.append((k, b" ".join(shuffled).decode(), None, None, None))
    total = lambda d: lm_score.scores(lm_score.coded(d, words), words, network).agg(F.sum("log_likelihood")).first()[0]
    assert total(spark.createDataFrame(rows, SCHEMA)) < total(docs)


def test_language_model_trains_on_every_position():
    """Each word is a target of one pass, also in texts of one word; no pass sees one residue of a periodic text alone."""
    texts = [np.arange(n, dtype=np.int16) % 4 for n in (1, 0, 3, 400, 1, 8, 1000)]
    ((codes, places, sizes),) = lm_score._portions(pa.array([t.tobytes() for t in texts], pa.binary()))
    step = lm_score.dealt(codes, places, sizes, lm_score.PASSES)
    assert len(step) == sum(map(len, texts)) and set(step) <= set(range(len(lm_score.PASSES)))
    assert {(k, c) for k, c in zip(step, codes[places], strict=True)} == set(itertools.product(range(len(lm_score.PASSES)), range(4)))


def test_language_model_learns_from_one_word_texts(spark):
    docs = spark.createDataFrame([(k, f"w{k % 7}", "en", "s", 2) for k in range(400)], SCHEMA)
    words = lm_score.vocabulary(docs)
    network = lm_score.train(lm_score.coded(docs, words).cache(), words)
    assert not np.array_equal(network.flat, lm_score.Network.start(words.counts).flat)


@pytest.mark.parametrize("held", [1000, 200_000])
def test_language_model_words_have_their_shares_of_a_class(spark, monkeypatch, held):
    """Two words of one class, one of them three times as frequent, whether their shares are held or joined."""
    frequent = [f"f{k}" for k in range(lm_score._CLASSES - lm_score.RARE)]
    names = [f"t{k}" for k in range(2000)]
    a = names[0]
    b = next(w for w in names[1:] if lm_score._rare(w.encode()) == lm_score._rare(a.encode()))
    texts = [" ".join(frequent)] * 9 + [" ".join(f"x{k}" for k in range(60)) for _ in range(8)] + [a, a, a, b]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(lm_score, "HELD_SHARES", held)
    found = {r.doc_id: r.log_likelihood for r in lm_score.score_documents(docs).collect()}
    assert found[len(texts) - 2] - found[len(texts) - 1] == pytest.approx(np.log(3), abs=1e-6)
    words = lm_score.vocabulary(docs)
    assert words.counts.sum() == sum(len(lm_score.split(t)) for t in texts)


def test_language_model_odd_cases(spark):
    df, rows = odd_documents(spark, extra=True)
    out = lm_score.score_documents(df, passes=(2,)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.mean_log_likelihood is None) == (r.n_words == 0) and (r.n_words > 0 or r.log_likelihood == 0)
    assert len({round(r.log_likelihood, 3) for r in out if r.doc_id in (0, 1)}) == 1
    assert lm_score.score_documents(empty_documents(spark)).count() == 0


# --- n-gram join


def plain_join(rows, words=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        same = (rows[i][1] or "") == (rows[j][1] or "")
        if same or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {rows[k][0]: (rows[find(k)][0], links[k]) for k in range(len(rows))}


def near_copies(n, block=False):
    """Texts, near copies with a word changed here and there, exact copies, and texts that share a passage."""
    r = random.Random(4)
    rows, base = [], [prose(100 + k, 90, 10**6).split() for k in range(6)]
    for k in range(n):
        w = list(base[k % 6] if not block else base[0])
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(n + k, prose(900, 25, 10**6) + " " + prose(901 + k, 60, 10**6)) for k in range(10)]
    return rows


def stated(rows):
    """What similar() says of each row, from plain_join and plain similarities."""
    grams = lambda t: {tuple(w[i : i + min(5, len(w))]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4)) if w}
    plain, text = plain_join(rows), dict(rows)
    copies = {t: sum(x == t for _, x in rows) for _, t in rows}
    like = {k: len(grams(t) & grams(text[plain[k][0]])) / max(1, len(grams(t) | grams(text[plain[k][0]]))) if t != text[plain[k][0]] else 1.0 for k, t in rows}
    out = {}
    for k, t in rows:
        head = text[plain[k][0]]
        if t == head:
            linked = sum(like[j] >= 0.8 and text[j] != head for j, _ in rows if plain[j][0] == plain[k][0])
        else:
            linked = copies[head] if like[k] >= 0.8 else 0
        out[k] = plain[k][0], min(j for j, x in rows if x == t), copies[t], pytest.approx(like[k]), copies[t] - 1 + linked
    return out


@pytest.mark.parametrize("block,rows_a_member", [(256, 4), (8, 4), (8, 0)])
def test_join_equals_a_plain_version(spark, monkeypatch, block, rows_a_member):
    monkeypatch.setattr(ngram_join, "ROWS_A_MEMBER", rows_a_member)
    rows = near_copies(120, block=block == 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = ngram_join.similar(df, block=block).collect()
    assert {r.doc_id: (r.class_id, r.text_id, r.n_copies, r.similarity, r.n_links) for r in out} == stated(rows)
    if rows_a_member:
        every = ngram_join.similar(df, block=block, count_links=True).collect()
        assert {r.doc_id: (r.class_id, r.n_all_links) for r in every} == plain_join(rows)
        assert [r[:6] for r in sorted(every)] == [r[:6] for r in sorted(out)]


def test_join_loses_no_class_of_many_near_copies(spark):
    """Copies of copies, edited further and further, and edits of one text: all classes are those of all pairs."""
    r = random.Random(8)
    rows, chain, base = [], prose(50, 100, 10**6).split(), prose(60, 120, 10**6).split()
    for k in range(60):  # each is linked with the next few only
        chain[r.randrange(100)] = f"c{k}"
        rows.append((k, " ".join(chain)))
    for k in range(300):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6, 9])):
            w[r.randrange(120)] = f"new{r.randrange(10**6)}"
        rows.append((100 + k, " ".join(w)))
    out = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=16).collect()
    plain = plain_join(rows)
    assert {x.doc_id: x.class_id for x in out} == {k: c for k, (c, _) in plain.items()}
    assert min(x.similarity for x in out) < 0.5  # the chain's end and its first text


def test_join_rows_of_a_group_grow_with_its_members(spark):
    """The cells of a group whose members meet at one pivot hold a few rows a member, whatever their number."""
    r, base = random.Random(2), prose(70, 200, 10**6).split()
    made = []
    for n in (100, 400):
        rows = []
        for k in range(n):
            w = list(base)
            w[r.randrange(200)] = f"n{k}"
            rows.append((k, " ".join(w)))
        keyed = ngram_join._keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
        classes = ngram_join._classes(keyed, 5, 0.8, 0.9999)
        members = ngram_join._buckets(classes)
        joined = ngram_join._components(ngram_join._packed(classes), members, ngram_join._grams(keyed, classes, members, 5), 0.8, 8)
        assert joined.select("component").distinct().count() == 1 and joined.count() == n
        labelled = members.join(joined, "node").withColumnRenamed("component", "label")
        made.append(ngram_join._open(labelled, classes.select("node", "n")).count())
    assert made == [0, 0]


def test_join_finds_the_pairs_that_bands_miss(spark, monkeypatch):
    """Short texts of 10 words each, in pairs at exactly 0.8, and a group of them around a common passage; with one band, most pairs share no bucket."""
    r, rows = random.Random(4), []
    for k in range(150):
        w = [f"p{k}x{j}" for j in range(13)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:-1], "end"]))]
    common = [f"c{j}" for j in range(12)]
    rows += [(1000 + k, " ".join([*common, *(f"own{k}y{j}" for j in range(r.randrange(30)))])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "bands_for", lambda *_: (1, 4))
    plain = plain_join(rows)
    for few in (32, 1):  # the second: n-grams one by one
        monkeypatch.setattr(ngram_join, "PREFIX_FEW", few)
        assert {x.doc_id: (x.class_id, x.n_all_links) for x in ngram_join.similar(df, count_links=True).collect()} == plain
        assert {x.doc_id: (x.class_id, x.text_id, x.n_copies, x.similarity, x.n_links) for x in ngram_join.similar(df).collect()} == stated(rows)
    assert ngram_join.keep_one(df).count() == len({c for c, _ in plain.values()})


def rows_made(spark, monkeypatch, run):
    """Rows that all steps in Python return while run() is under way."""
    made, frame = spark.sparkContext.accumulator(0), type(spark.range(1))

    def counted(self, part, *more, plain=frame.mapInArrow, **named):
        def watched(batches):
            for batch in part(batches):
                made.add(batch.num_rows)
                yield batch

        return plain(self, watched, *more, **named)

    with monkeypatch.context() as patch:
        patch.setattr(frame, "mapInArrow", counted)
        run()
    return made.value


def group_with_outsiders(n):
    """Near copies of one text, a quarter of which are edited too far to be linked with it."""
    r, base, rows = random.Random(5), prose(80, 120, 10**6).split(), []
    for k in range(n):
        w = list(base)
        for j in r.sample(range(120), r.choice([3, 4]) if k % 4 == 0 else 1):
            w[j] = f"n{k}x{j}"
        rows.append((k, " ".join(w)))
    return rows


def test_join_makes_no_row_a_pair(spark, monkeypatch):
    """Four times the members of a group, some in its class and some not, make about four times the rows, not six."""
    frames = [spark.createDataFrame(group_with_outsiders(n), "doc_id long, text string").repartition(4) for n in (100, 400)]
    few, many = (rows_made(spark, monkeypatch, lambda df=df: ngram_join.similar(df).collect()) for df in frames)
    assert many < 5 * few


def test_near_duplicate_stage_makes_no_row_a_pair(spark, data, monkeypatch):
    import corpus_pipeline

    frames = [spark.createDataFrame(group_with_outsiders(n), "doc_id long, text string").repartition(4) for n in (100, 400)]
    few, many = (rows_made(spark, monkeypatch, lambda df=df: corpus_pipeline.near_duplicate_stage(spark, df, data).collect()) for df in frames)
    assert many < 5 * few, (few, many)


def idle_memory(spark):
    """MB that the Python workers keep of what they have freed, at most; afterwards they keep none."""

    def part(batches):
        import ctypes

        held = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1])  # noqa: E731, SIM115
        for _ in batches:
            time.sleep(0.05)  # so that all workers get tasks
            before = held()
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
            yield pa.RecordBatch.from_arrays([pa.array([(before - held()) // 1024], pa.int64())], ["mb"])

    return spark.range(0, 32, 1, 32).mapInArrow(part, "mb bigint").agg(F.max("mb")).first()[0]


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "decontamination"])
def test_stages_leave_no_memory_in_workers(spark, data, stage):
    """Workers stay for later stages, and each executor's memory has to hold several of them."""
    import corpus_pipeline

    text = F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat_ws(" ", F.lit("Some words of a line"), F.md5(F.concat_ws(" ", "doc_id", k)), F.lit("and its end"))))
    docs = spark.range(24_000).withColumnRenamed("id", "doc_id").repartition(4).select("doc_id", text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    idle_memory(spark)
    dict(corpus_pipeline.STAGES)[stage](spark, docs, data).write.format("noop").mode("overwrite").save()
    kept = idle_memory(spark)
    assert kept < 40  # the last batch goes after the release


def test_join_by_prefixes_alone(spark, monkeypatch):
    """Where no two texts share a bucket, prefixes find all links, in cells of any size."""
    monkeypatch.setattr(ngram_join, "band_hashes", lambda grams, bands, rows: grams[:1].view(np.int64) ^ hash(grams.tobytes()) if len(grams) else np.zeros(0, np.int64))
    rows = near_copies(90) + [(1000 + k, t) for k, t in group_with_outsiders(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {x.doc_id: (x.class_id, x.text_id, x.n_copies, x.similarity, x.n_links) for block in (256, 8) for x in ngram_join.similar(df, block=block).collect()}
    assert found == stated(rows)
    assert {x.doc_id: (x.class_id, x.n_all_links) for x in ngram_join.similar(df, block=8, count_links=True).collect()} == plain_join(rows)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_first_grams_in_play(threshold):
    """All that a pair of different labels can take are kept; those that it takes are few, so some are dropped."""
    rng = np.random.default_rng(3)
    gram, label, n = np.sort(rng.integers(0, 40, 400)), rng.integers(0, 60, 400), rng.integers(1, 90, 400)
    n, at = n[np.lexsort((n, gram))], rng.integers(0, 30, 400)
    kept = ngram_join.in_play(gram, label, n, at, threshold)
    taken = np.zeros(400, bool)
    for x, y in itertools.permutations(range(400), 2):
        need, k = ngram_join._needed(n[x : x + 1], n[y : y + 1], threshold)
        taken[x] |= gram[x] == gram[y] and label[x] != label[y] and min(n[x], n[y]) >= need[0] and min(n[x] - at[x], n[y] - at[y]) > need[0] - k[0]
    assert taken.any() and kept[taken].all() and not kept.all()


def test_join_has_the_words_of_its_sql(spark, tmp_path):
    """Blanks beyond ASCII and the vertical tab are no white space there, and letters are lower-cased one by one."""
    import duckdb

    long = " ".join(f"w{k}" for k in range(12))
    texts = ["a\u00a0b c", "a b c", "a\vb d", "A\vB D", "\u1d6c\u2003x", "ΟΔΟΣ one", "οδοσ one", "οδος one", "\u0130 two", "i two", "i\u0307 two", "x\x1cy\t\f z", "X\x1cY Z", "\u00a0", "\v", long + " \u00a0", long]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = [tuple(x) for x in ngram_join.op9_ngram_join(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(base.execute(ngram_join.ORACLE).fetchall())


def test_join_odd_cases(spark):
    df, rows = odd_documents(spark, extra=True)
    out = ngram_join.similar(df).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by_id[0].class_id == by_id[1].class_id == by_id[12].class_id == 0 and by_id[2].class_id == by_id[9].class_id == 2
    assert by_id[3].class_id == by_id[4].class_id == 3 and by_id[5].class_id == 5 and by_id[8].n_links == 0 and by_id[9].n_copies == 3
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 5, 6, 7, 8]
    assert ngram_join.similar(empty_documents(spark)).count() == ngram_join.keep_one(empty_documents(spark)).count() == 0


def test_join_of_repeated_rows_and_ids(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "w"), (1, "completely other text", "z"), (2, "other words in this one", "y"), (2, "a b c d e f", "y"), (None, "nobody's text here", "1"), (None, "nobody's text here", "1"), (None, "another of nobody", None)]
    twice = spark.createDataFrame(rows, "doc_id long, text string, __gone string")
    kept = ngram_join.keep_one(twice).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "another of nobody"), (0, "nobody's text here"), (1, "a b c d e f"), (1, "completely other text"), (2, "other words in this one")]
    assert kept[0].asDict().keys() == {"doc_id", "text", "__gone"}
    assert sorted(map(str, ngram_join.keep_one(twice.repartition(5)).collect())) == sorted(map(str, kept))
    named = twice.withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))
    assert ngram_join.keep_one(named).count() == len(kept)
    assert {r.class_id for r in ngram_join.similar(named).where("doc_id IS NOT NULL").collect()} == {"id-1", "id-2"}


@pytest.mark.parametrize("n,most", [(5, 30), (20, 30), (20, 400), (20, 10**6)])
def test_intersections_in_parts(n, most):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(n)]
    every, half = np.arange(n), n // 2
    for left, right in ((every, every), (every[:half], every[half:])):
        found = ngram_join._shared_in_parts(sets, left, right, most)
        for x, i in enumerate(left):
            for y, j in enumerate(right):
                assert i == j or found[x, y] == len(np.intersect1d(sets[i], sets[j]))


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9, 1.0):
        bands, rows = ngram_join.bands_for(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= ngram_join.RECALL - 1e-12


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(500, 500 + k) for k in range(1, 60)] + [(600 + k, 601 + k) for k in range(60)] + [(7, 7)]
    found = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {k: k for e in edges for k in e}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    alone = {k for k in root if not any(k in e and e[0] != e[1] for e in edges)}
    assert found == {k: find(k) for k in root if k not in alone}


# --- pipeline


def test_pipeline(spark, data, tmp_path):
    import corpus_pipeline

    docs, names = spark.read.parquet(f"{data}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        names.append(name)
        if k < 3:
            assert docs.columns == before.columns and docs.count() <= before.count() and docs.count() > 100
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert spark.read.parquet(f"{tmp_path}/2").where("n_chars <> length(text)").count() == 0
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    assert decontam.scan_documents(docs, bench).where("contaminated").count() == 0
    assert spark.read.parquet(f"{tmp_path}/1").count() == ngram_join.similar(spark.read.parquet(f"{tmp_path}/0")).select("class_id").distinct().count()
    for s in docs.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("most"), F.countDistinct("slot").alias("d")).collect():
        assert s.n == s.d == s.most + 1
    assert corpus_pipeline.run(spark, data).count() == docs.count() and SCHEMA


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_odd_cases(spark, tmp_path, empty):
    import corpus_pipeline

    docs, rows = odd_documents(spark, extra=True)
    if empty:
        docs, rows = docs.limit(0), []
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [] if empty else [(0, 1, 0), (2, 1, 0), (7, 0, 0), (6, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bench = [] if empty else [(1, prose(2, 60)), (2, None), (3, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
    assert {"region", "rack", "shard", "slot"} <= set(docs.columns) and sizes[4] == sizes[3]
    if empty:
        assert sizes == [0] * 5
    else:
        assert 0 < sizes[0] <= len(rows) and sizes[1] < sizes[0]
        assert docs.where("doc_id IN (2, 9)").count() == 0  # all of it is in the benchmark
