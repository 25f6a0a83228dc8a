"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised test items has a state for each set of
positions that a run of item words can end at. A document's words stream
through it; the length of the longest run of item words that ends at a word
tells whether a window of `window` words, or a whole shorter item, ends there.

What a state needs to know of the states that its suffix links lead to is
worked out beforehand, so a scan takes time in proportion to the text. The
automaton is flat arrays, some tens of bytes an item word. Items of more words
than one automaton takes are dealt out over several, and each document's spans
and items are put together.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from substrata.llm.common import cut, in_arrow, table, union_all

WINDOW_WORDS = 10
#: An automaton goes to every task: items of more words than this in all get several, each scanned with by itself.
BLOCK_WORDS = 500_000
#: What the arrays of one automaton may take; two states and three moves a word take less, but for words of great length.
MOST_BYTES = 256 << 20
#: In the pipeline: hit words go, and documents of which more than this share is hit.
MAX_COVERAGE = 0.5

# Words are runs of digits, letters a-z and all characters beyond ASCII; on UTF-8 bytes that is a table of 256 entries.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Of word sequences, named; state 0 is the root. Walk with scan(). It is pickled as arrays and looks words up in tables that are made anew."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW_WORDS):
        self.window = window
        self.names = [name for name, _ in items]
        vocabulary: dict[bytes, int] = {}
        coded = [array("i", [vocabulary.setdefault(w, len(vocabulary)) for w in ws]) for _, ws in items]
        self.words = b" ".join(vocabulary)
        self.kinds = max(1, len(vocabulary))
        link, length = array("i", [-1]), array("i", [0])
        moves: dict[int, int] = {}  # state * kinds + word -> state
        leaving = [array("i")]  # words that lead on from each state
        kinds = self.kinds

        def new(size: int, to: int) -> int:
            link.append(to)
            length.append(size)
            leaving.append(array("i"))
            return len(link) - 1

        def split(p: int, c: int) -> int:
            """The state of p's longest run and c, of exactly that length."""
            q = moves[p * kinds + c]
            if length[q] == length[p] + 1:
                return q
            copy = new(length[p] + 1, link[q])
            leaving[copy] = leaving[q][:]
            for x in leaving[q]:
                moves[copy * kinds + x] = moves[q * kinds + x]
            link[q] = copy
            while p >= 0 and moves.get(p * kinds + c) == q:
                moves[p * kinds + c] = copy
                p = link[p]
            return copy

        for codes in coded:
            last = 0
            for c in codes:
                if last * kinds + c in moves:  # an earlier item has this run
                    last = split(last, c)
                    continue
                state, p = new(length[last] + 1, 0), last
                while p >= 0 and p * kinds + c not in moves:
                    moves[p * kinds + c] = state
                    leaving[p].append(c)
                    p = link[p]
                if p >= 0:
                    link[state] = split(p, c)
                last = state
        self.link, self.length = link, length
        del leaving
        table = np.fromiter(moves.items(), np.dtype((np.int64, 2)), len(moves)) if moves else np.zeros((0, 2), np.int64)
        self.moves = table[np.argsort(table[:, 0])]
        self._owners(coded, moves)

    def _owners(self, coded: list[array], moves: dict[int, int]) -> None:
        """For each state: the one of its last `window` words, the nearest one at which a short item ends, and the items of both kinds."""
        n, window, link, length, kinds = len(self.link), self.window, self.link, self.length, self.kinds
        order = np.argsort(np.frombuffer(length, np.int32), kind="stable").tolist()
        self.at_window = array("i", [-1]) * n
        for s in order[1:]:
            if length[s] >= window:
                self.at_window[s] = self.at_window[link[s]] if length[link[s]] >= window else s
        of_window: set[tuple[int, int]] = set()
        of_short: set[tuple[int, int, int]] = set()
        for k, codes in enumerate(coded):
            state = 0
            for at, c in enumerate(codes, 1):
                state = moves[state * kinds + c]
                if at >= window:
                    of_window.add((self.at_window[state], k))
            if 0 < len(codes) < window:
                of_short.add((self._suffix(state, len(codes)), len(codes), k))
        self.short_rows = np.array(sorted(of_short), np.int32).reshape(-1, 3)
        self.window_rows = np.array(sorted(of_window), np.int32).reshape(-1, 2)
        self.at_short = array("i", [-1]) * n
        for s in self.short_rows[:, 0].tolist():
            self.at_short[s] = s
        for s in order[1:]:
            if self.at_short[s] < 0:
                self.at_short[s] = self.at_short[link[s]]
        self.least = min([window, *self.short_rows[:, 1].tolist()])

    def _suffix(self, state: int, length: int) -> int:
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    @property
    def nbytes(self) -> int:
        return len(self.words) + sum(map(len, self.names)) + self.moves.nbytes + self.short_rows.nbytes + self.window_rows.nbytes + 4 * sum(map(len, (self.link, self.length, self.at_window, self.at_short)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    @functools.cached_property
    def _tables(self) -> tuple:
        """Word -> number, the only or first word that leads on from a state and where to, other moves, items by state."""
        vocabulary = {w: k for k, w in enumerate(self.words.split(b" "))} if self.words else {}
        state, word = np.divmod(self.moves[:, 0], self.kinds)
        first = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]])) if len(state) else np.zeros(0, int)
        only, to = np.full(len(self.link), -1, np.int32), np.zeros(len(self.link), np.int32)
        only[state[first]], to[state[first]] = word[first], self.moves[first, 1]
        others = np.ones(len(state), bool)
        others[first] = False
        more = dict(zip(self.moves[others, 0].tolist(), self.moves[others, 1].tolist(), strict=True))
        windows: dict[int, list[int]] = {}
        for s, k in self.window_rows.tolist():
            windows.setdefault(s, []).append(k)
        shorts: dict[int, list[tuple[int, int]]] = {}
        for s, size, k in self.short_rows.tolist():
            shorts.setdefault(s, []).append((size, k))
        return vocabulary, array("i", only.tobytes()), array("i", to.tobytes()), more, windows, shorts

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans as (first word, word after the last), apart and in order, and the numbers of the items hit."""
        vocabulary, only, to, more, windows, shorts = self._tables
        link, lengths, least, window, kinds, at_window, at_short = self.link, self.length, self.least, self.window, self.kinds, self.at_window, self.at_short
        spans: list[tuple[int, int]] = []
        hit: set[int] = set()
        counted: set[int] = set()  # states whose windows' items are in hit
        state = length = 0
        for at, c in enumerate(map(vocabulary.get, text), 1):
            if c is None:
                state = length = 0
                continue
            while True:
                if only[state] == c:
                    state = to[state]
                    length += 1
                    break
                found = more.get(state * kinds + c)
                if found is not None:
                    state = found
                    length += 1
                    break
                state = link[state]
                length = lengths[state]  # a word of the vocabulary leads on from the root
            if length < least:
                continue
            covered = 0
            if length >= window:
                covered, s = window, at_window[state]
                if s not in counted:
                    counted.add(s)
                    hit.update(windows[s])
            s = at_short[state]
            while s > 0:  # each has a short item of another length
                for n, k in shorts[s]:
                    if n <= length:
                        hit.add(k)
                        covered = max(covered, n)
                s = at_short[link[s]]
            if covered:
                first = at - covered
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, at))
        return spans, hit


def blocks(items: Iterator[tuple[str, list[bytes]]], most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, in runs of so many words at most, or of one item."""
    run, size = [], 0
    for name, run_words in items:
        if run and size + len(run_words) > most:
            yield run
            run, size = [], 0
        if run_words:
            run.append((name, run_words))
            size += len(run_words)
    yield run


def build(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW_WORDS, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """The automata of all items, one at a time; the driver fetches the items one after another.

    Null and wordless items have no window. Items that share an id count as
    one, a null id as an empty one.
    """
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL").orderBy("item", "text")
    for run in blocks(((r["item"], words(r["text"])) for r in items.toLocalIterator()), block_words):
        made = Automaton(run, window)
        if made.nbytes > MOST_BYTES:
            raise ValueError(f"{made.nbytes} bytes of automaton; set block_words below {block_words}")
        yield made


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and out[-1][1] >= a:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


_FOUND = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<array<bigint>>"


def _report(batch: pa.RecordBatch, kept: list[str], found: list[tuple[int, list, list[str]]]) -> pa.RecordBatch:
    """The columns kept and _FOUND, from words, spans and sorted names of items."""
    hits = [sum(b - a for a, b in spans) for _, spans, _ in found]
    return pa.RecordBatch.from_arrays(
        [
            *(batch.column(c) for c in kept), pa.array([n for n, _, _ in found], pa.int64()), pa.array(hits, pa.int64()), pa.array([len(names) for _, _, names in found], pa.int64()),
            pa.array([hashlib.sha256(",".join(names).encode()).hexdigest() for _, _, names in found], pa.string()), pa.array([n > 0 for n in hits], pa.bool_()), pa.array([[list(s) for s in spans] for _, spans, _ in found], pa.list_(pa.list_(pa.int64()))),
        ],
        [*kept, *(c.split()[0] for c in _FOUND.split(", "))],
    )


def _scanned(rows: DataFrame, automata: Iterator[Automaton]) -> DataFrame:
    """From (key, text): key and _FOUND. One automaton is scanned with at once; with several, each one's finds are kept and put together."""
    context, kind = rows.sparkSession.sparkContext, dict(rows.dtypes)["key"]
    first, second = next(automata), next(automata, None)
    if second is None:
        shared = context.broadcast(first)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton: Automaton = shared.value
            for batch in batches:
                runs = [words(x.as_py()) for x in batch.column("text")]
                found = [(len(run), *automaton.scan(run)) for run in runs]
                yield _report(batch, ["key"], [(n, spans, sorted({automaton.names[k] for k in hit})) for n, spans, hit in found])

        return in_arrow(rows, part, f"key {kind}, {_FOUND}")
    rows, kept = cut(rows.withColumn("row", F.monotonically_increasing_id())), []
    for automaton in itertools.chain((first, second), automata):
        one = context.broadcast(automaton)

        def hits(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(k, *one.value.scan(words(x.as_py()))) for k, x in enumerate(batch.column("text"))]
                found = [(k, spans, sorted({one.value.names[i] for i in hit})) for k, spans, hit in found if hit]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array([k for k, _, _ in found], pa.int64())), pa.array([[list(s) for s in spans] for _, spans, _ in found], pa.list_(pa.list_(pa.int64()))), pa.array([names for _, _, names in found], pa.list_(pa.string()))], ["row", "spans", "names"])

        kept.append(cut(in_arrow(rows.select("row", "text"), hits, "row bigint, spans array<array<bigint>>, names array<string>")))
        one.destroy()
    found = union_all(kept).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("text", "spans", "names"))
            yield _report(batch, ["key"], [(len(words(t)), merged(s or []), sorted(n or [])) for t, s, n in zip(*columns, strict=True)])

    return in_arrow(rows.join(found, "row", "left").select("key", "text", "spans", "names"), together, f"key {kind}, {_FOUND}")


def scan_documents(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Return (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for every row.

    items_sha256: SHA-256 of the ids of items hit, sorted as strings, comma-joined
    (of the empty string if none). spans: ARRAY of [first, after last] word
    numbers. Null texts have no words; ids may be null or repeat, each row is
    scanned for itself. Texts are scanned whole, in time in proportion to
    their length. Other columns are left out. Empty tables: no rows, or no hits.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return _scanned(rows, build(benchmark, window=window, block_words=block_words)).withColumnRenamed("key", "doc_id")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between those words."""
    data = text.encode("utf-8", "surrogatepass")
    folded = data.translate(_TABLE)
    out, done, at, k = [], 0, 0, 0
    number = 0
    while k < len(spans):
        # find the byte places of words number spans[k][0] and spans[k][1] - 1
        while at < len(folded) and folded[at] == 32:
            at += 1
        end = folded.find(b" ", at)
        end = len(folded) if end < 0 else end
        if number == spans[k][0]:
            out.append(data[done:at])
        number += 1
        if number == spans[k][1]:
            done, k = end, k + 1
        at = end
    out.append(data[done:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def _cleaned(docs: DataFrame, automaton: Automaton, place: int, max_coverage: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = shared.value
        for batch in batches:
            texts, keep = [], []
            for value in batch.column(place):
                text = value.as_py()
                run = words(text)
                spans, _ = automaton.scan(run)
                keep.append(sum(b - a for a, b in spans) <= max_coverage * len(run))
                while spans and keep[-1]:
                    text = without_spans(text, spans)
                    spans, _ = automaton.scan(words(text))
                texts.append(text)
            arrays = [pa.array(texts, batch.schema.field(place).type) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return in_arrow(docs, part, docs.schema)


def _cleaned_by_several(docs: DataFrame, automata: list[Automaton], text_col: str, max_coverage: float) -> DataFrame:
    """The same with several automata: spans of all of them are cut at once, and changed texts are scanned again until none is hit."""
    columns = [F.col("key")[c].alias(c) for c in docs.columns]
    kind = docs.schema[text_col].dataType.simpleString()
    limit, rows, done = max_coverage, docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("key"), F.col(text_col).alias("text")), []

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without_spans(t, [tuple(s) for s in spans]) for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    while True:
        kept = rows.select(F.struct("key", "text").alias("key"), "text")
        found = cut(_scanned(kept, iter(automata)).where(F.col("n_hit") <= F.lit(limit) * F.col("n_words")))
        done.append(found.where("n_hit = 0").select("key.key", "key.text"))
        hit = found.where("n_hit > 0").select("key.key", "key.text", "spans")
        if not hit.limit(1).count():
            break
        rows, limit = cut(in_arrow(hit, without, f"key {dict(hit.dtypes)['key']}, text string")), 1.0
    out = union_all(done)
    return out.select(*[F.col("text").cast(kind).alias(c) if c == text_col else x for c, x in zip(docs.columns, columns, strict=True)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW_WORDS, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without hit spans, and without those of which more than max_coverage of the words are hit.

    All columns stay; only the text of hit documents changes. If cutting a
    span joins words to a new window, that is cut too. Null texts stay null,
    empty ones empty, and repeated rows are each treated alike. Texts are read
    whole, whatever their length. Empty tables: no rows, or no change.
    """
    automata = list(build(benchmark, window=window, block_words=block_words))
    if len(automata) == 1:
        return _cleaned(docs, automata[0], docs.columns.index(text_col), max_coverage)
    return _cleaned_by_several(docs, automata, text_col, max_coverage)


def op5_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


ORACLE = r"""
    WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM win),
    dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
    m AS (SELECT doc_id, item, i, dg.n FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
    h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
    SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN t ON dw.doc_id = t.doc_id"""
