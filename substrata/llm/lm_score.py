"""Language-model scores: masked pseudo-likelihood.

A network reads the words on both sides of a word, through embeddings and one
hidden layer, and predicts the word that is masked out. A document's score is
the sum of the log-probabilities of all its words, each given its neighbours.

Words are counted over the whole corpus. The most frequent have a class of
their own; the others share hashed classes, within which each word is as
likely as its share of the class's count says. A class is predicted as a group and a member of the group, so a
prediction takes two short softmaxes. Training passes over all documents: the
positions are dealt out over the passes, so that every word is a target in
one of them, and the tasks' networks are averaged by the words they saw.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from substrata.llm.common import cut, keep_heap, remove, table, work_path

GROUPS, MEMBERS = 32, 32
RARE = 64
SIDE = 2
EMBEDDING, HIDDEN = 16, 32
#: One pass for each entry, with that share of all positions: each position is a target of exactly one pass.
PASSES = (1, 15)
BATCH, RATE = 1024, 0.05
PORTION_WORDS, STEP_WORDS = 1 << 16, 1 << 13

_CLASSES = GROUPS * MEMBERS
_PAD = _CLASSES
#: The shares of so many of the most frequent words go to every task; those of all others are joined from the table of counts.
HELD_SHARES = 200_000
#: A task remembers the classes of so many other words at a time.
REMEMBERED = 400_000
#: Words that a task counts at a time.
HELD_WORDS = 300_000


def split(text: str | None) -> list[bytes]:
    """Runs between ASCII white space, A-Z in lower case; full stops and commas are words of their own."""
    return (text or "").encode("utf-8", "surrogatepass").lower().replace(b".", b" . ").replace(b",", b" , ").split()


class Codes(dict):
    """Word -> rank if its share is held, else -1 - its hashed class."""

    def __missing__(self, word: bytes) -> int:
        code = -1 - _rare(word)
        if len(self) < HELD_SHARES + REMEMBERED:
            self[word] = code
        return code


def _rare(word: bytes) -> int:
    return _CLASSES - RARE + zlib.crc32(word) % RARE


@dataclass
class Vocabulary:
    codes: Codes
    #: log of a word's share of its class, by rank: 0 for words with a class of their own.
    within: np.ndarray
    #: by class, over the whole corpus
    counts: np.ndarray
    #: class by rank
    classes: np.ndarray | None = None
    #: (word, n): the counts of all words
    table: DataFrame | None = None
    #: whether the shares of all words are held
    whole: bool = True


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts. A task counts HELD_WORDS distinct words at a time before it hands them on."""

    def rows(counts: Counter[bytes]) -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in some], pa.string()), pa.array([counts[w] for w in some], pa.int64())], ["word", "n"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(split(text.as_py()))
                if len(counts) > HELD_WORDS:
                    yield from rows(counts)
                    counts = Counter()
        yield from rows(counts)

    return docs.select(F.col(text_col)).mapInArrow(part, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """The most frequent words, of equally frequent ones the first in code-point order, and what the classes hold."""
    words = cut(count_words(docs, text_col))
    frequent = words.orderBy(F.desc("n"), "word").limit(_CLASSES - RARE).collect()
    own = len(frequent)
    found = {r["word"]: r["n"] for r in frequent}
    levels = sorted(((r["n"], r["types"]) for r in words.groupBy("n").agg(F.count("*").alias("types")).collect()), reverse=True)
    types = np.cumsum([t for _, t in levels])
    within_limit = int(np.searchsorted(types, HELD_SHARES, "right"))
    if within_limit:
        more = words.where(F.col("n") >= levels[within_limit - 1][0]).toArrow()
        for w, k in zip(more.column("word").to_pylist(), more.column("n").to_pylist(), strict=True):
            found.setdefault(w, k)
    names, n = [w.encode() for w in found], np.array([*found.values()], float)
    classes = np.array([*range(own), *map(_rare, names[own:])], np.int16)
    counts = np.zeros(_CLASSES)
    for r in words.groupBy((F.crc32(F.col("word").cast("binary")) % RARE).alias("k")).agg(F.sum("n").alias("n")).collect():
        counts[_CLASSES - RARE + r["k"]] = r["n"]
    for k in range(own):
        counts[_rare(names[k])] -= n[k]
        counts[k] = n[k]
    return Vocabulary(Codes(zip(names, range(len(names)), strict=True)), np.log(n / counts[classes]), counts, classes, words, len(levels) == 0 or len(names) == types[-1])


_SHAPES = {"embed": (_CLASSES + 1, EMBEDDING), "w1": (2 * SIDE * EMBEDDING, HIDDEN), "b1": (HIDDEN,), "groups": (HIDDEN + 1, GROUPS), "members": (GROUPS, HIDDEN + 1, MEMBERS)}
_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())
_AROUND = np.array([k for k in range(-SIDE, SIDE + 1) if k])
_PAIRS = np.arange(EMBEDDING // 2)
_STARTS = np.arange(GROUPS + 1, dtype=np.int16) * np.int16(MEMBERS)


class Network:
    """Weights as parts of one array. The last row of `groups`, and of each group's `members`, is the bias: the hidden units have a constant 1 after them."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32)
        at = 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size
        self.wg, self.bg = self.groups[:HIDDEN], self.groups[HIDDEN]
        self.wm, self.bm = self.members[:, :HIDDEN], self.members[:, HIDDEN]
        self.slope: Network | None = None

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small random weights, and biases by which each class is as likely as its count says."""
        out = cls(np.random.default_rng(7).normal(0, 0.1, _SIZE))
        share = (counts + 0.5).reshape(GROUPS, MEMBERS)
        out.b1[:] = 0
        out.bg[:] = np.log(share.sum(1) / share.sum())
        out.bm[:] = np.log(share / share.sum(1, keepdims=True))
        out.wg[:] = 0
        out.wm[:] = 0
        return out

    def hidden(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        around = codes.take(at[:, None] + _AROUND)
        joined = self.embed.take(around, axis=0).reshape(len(at), -1)
        h = np.empty((len(at), HIDDEN + 1), np.float32)
        h[:, HIDDEN] = 1
        x = np.dot(joined, self.w1)
        x += self.b1
        _tanh(x, h[:, :HIDDEN])
        return around, joined, h

    def member_logits(self, h: np.ndarray, ends: list[int]) -> np.ndarray:
        """Of rows by group, the logits of the group's members."""
        out = np.empty((len(h), MEMBERS), np.float32)
        for weights, a, b in zip(self.members, ends[:-1], ends[1:], strict=True):
            if a < b:
                np.dot(h[a:b], weights, out[a:b])
        return out

    def log_probabilities(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the classes at these places, each given its neighbours."""
        order, group, member, ends = _by_group(codes, at)
        _, _, h = self.hidden(codes, at[order])
        logits = np.dot(h, self.groups)
        found = logits.ravel()[group] - _log_total(logits)
        logits = self.member_logits(h, ends)
        found += logits.ravel()[member] - _log_total(logits)
        out = np.empty_like(found)
        out[order] = found
        return out

    def train(self, codes: np.ndarray, at: np.ndarray, memory: np.ndarray, rate: float = RATE) -> None:
        """One step of Adagrad on the mean loss at these places."""
        if self.slope is None:
            self.slope = Network(np.zeros(_SIZE))
        s = self.slope
        n = np.float32(len(at))
        order, group, member, ends = _by_group(codes, at)
        around, joined, h = self.hidden(codes, at[order])
        p = _softmax(np.dot(h, self.groups))
        p.ravel()[group] -= 1
        p /= n
        np.dot(h.T, p, s.groups)
        back = np.dot(p, self.wg.T)
        p = _softmax(self.member_logits(h, ends))
        p.ravel()[member] -= 1
        p /= n
        more, turned = np.empty_like(back), h.T
        for weights, slope, a, b in zip(self.wm, s.members, ends[:-1], ends[1:], strict=True):
            if a < b:
                rows = p[a:b]
                np.dot(turned[:, a:b], rows, slope)
                np.dot(rows, weights.T, more[a:b])
            else:
                slope[:] = 0
        back += more
        units = h[:, :HIDDEN]
        back *= 1 - units * units
        np.dot(joined.T, back, s.w1)
        back.sum(0, out=s.b1)
        parts = np.dot(back, self.w1.T)
        s.embed[:] = 0
        # added up in pairs of numbers, as complex ones, which takes half the steps
        np.add.at(s.embed.ravel().view(np.complex64), (around.reshape(-1, 1) * np.intp(len(_PAIRS)) + _PAIRS).ravel(), parts.ravel().view(np.complex64))
        slope = s.flat
        root = slope * slope
        memory += root
        np.sqrt(memory, out=root)
        root += np.float32(1e-6)
        slope *= np.float32(rate)
        slope /= root
        self.flat -= slope


def _by_group(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """An order of the places by their classes' groups; in it, where each one's group and member are among the logits, row after row, and where each group ends."""
    found = codes.take(at)
    order = np.argsort(found, kind="stable")
    found = found[order]
    group = found // MEMBERS
    return order, np.arange(0, len(at) * GROUPS, GROUPS) + group, np.arange(0, len(at) * MEMBERS, MEMBERS) + (found - group * MEMBERS), np.searchsorted(found, _STARTS).tolist()


_ONES = {n: np.ones(n, np.float32) for n in (GROUPS, MEMBERS)}


def _exp(logits: np.ndarray) -> np.ndarray:
    """In place of the logits. They are of moderate size (tanh times weights), so no maximum is taken off; the limit only guards."""
    if logits.max(initial=0) > 60:
        np.minimum(logits, 60, out=logits)
    return np.exp(logits, out=logits)


def _tanh(x: np.ndarray, out: np.ndarray) -> None:
    """By exp, which takes numpy less time than its tanh; x is used up."""
    x *= 2
    _exp(x)
    x += 1
    np.divide(-2, x, out=x)
    np.add(x, 1, out=out)


def _log_total(logits: np.ndarray) -> np.ndarray:
    """log of the sum of exp by row; logits are used up."""
    _exp(logits)
    return np.log(np.maximum(logits @ _ONES[logits.shape[1]], np.float32(1e-30)))


def _softmax(logits: np.ndarray) -> np.ndarray:
    """In place of the logits."""
    _exp(logits)
    logits *= (1 / np.maximum(logits @ _ONES[logits.shape[1]], np.float32(1e-30)))[:, None]
    return logits


def coded(docs: DataFrame, words: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, codes BINARY, held, others): the classes of each text's words, two bytes each; the sum of the log shares that are held, and the words, with their numbers, whose shares aren't.

    Null texts have no words. Rows are numbered apart.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words.codes, words.within, words.classes))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, within, classes = shared.value
        code = codes.__getitem__
        for batch in batches:
            made, held, others = [], [], []
            for text in batch.column("text"):
                run = split(text.as_py())
                found = np.fromiter(map(code, run), np.int32, len(run))
                known = found >= 0
                out = (-1 - found).astype(np.int16)
                ranks = found[known]
                out[known] = classes[ranks]
                made.append(out.tobytes())
                held.append(float(within[ranks].sum()))
                others.append([(w.decode("utf-8", "replace"), k) for w, k in Counter([run[i] for i in np.flatnonzero(~known).tolist()]).items()])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(made, pa.binary()), pa.array(held, pa.float64()), pa.array(others, pa.map_(pa.string(), pa.int64()))], ["row", "doc_id", "codes", "held", "others"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(part, f"row bigint, doc_id {dict(rows.dtypes)['doc_id']}, codes binary, held double, others map<string,bigint>")


def _portions(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some texts at a time: classes with padding around each text, places of the words, (number of words, words before) of each text."""
    texts = [np.frombuffer(x.as_py(), np.int16) for x in column]
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < PORTION_WORDS):
            size += len(texts[to])
            to += 1
        sizes = np.array([len(x) for x in texts[at:to]], np.int64)
        places = np.arange(size) + np.repeat(SIDE * np.arange(1, len(sizes) + 1), sizes)
        codes = np.full(size + SIDE * (len(sizes) + 1), _PAD, np.int16)
        codes[places] = np.concatenate(texts[at:to])
        yield codes, places, np.stack([sizes, np.cumsum(sizes) - sizes], 1)
        at = to


def dealt(codes: np.ndarray, places: np.ndarray, sizes: np.ndarray, passes: tuple[int, ...]) -> np.ndarray:
    """For each place the pass that has it as a target, drawn by a hash of the text and the word's number in it."""
    seeds = np.array([zlib.crc32(codes[places[at] : places[at] + n]) if n else 0 for n, at in sizes], np.uint64)
    number = np.arange(len(places), dtype=np.uint64) + np.repeat((seeds << np.uint64(20)) - sizes[:, 1].astype(np.uint64), sizes[:, 0])
    number *= np.uint64(0x9E3779B97F4A7C15)
    number ^= number >> np.uint64(32)
    number *= np.uint64(0xD6E8FEB86659FD93)
    return np.searchsorted(np.cumsum(passes), (number >> np.uint64(40)).astype(np.int64) % sum(passes), "right")


def train(texts: DataFrame, words: Vocabulary, passes: tuple[int, ...] = PASSES) -> Network:
    """Pass over all coded texts, with the share of the positions that each entry of `passes` says, and average the tasks' networks after each pass.

    What comes back is one network, whatever the number of tasks: theirs are
    summed parameter by parameter in Spark.
    """
    context = texts.sparkSession.sparkContext
    network = Network.start(words.counts)
    for step in range(len(passes)):
        shared = context.broadcast(network.flat)

        def part(batches: Iterator[pa.RecordBatch], shared=shared, step=step) -> Iterator[pa.RecordBatch]:
            keep_heap()
            own, memory, seen = Network(shared.value.copy()), np.full(_SIZE, 1e-4 * (step + 1), np.float32), 0
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0

            def learn() -> None:
                """On the places of the portions that wait, in batches."""
                base, codes, places = 0, [], []
                for c, p in waiting:
                    codes.append(c)
                    places.append(p + base)
                    base += len(c)
                all_codes, at = np.concatenate(codes), np.concatenate(places)
                at = np.random.default_rng(len(at)).permutation(at)
                for k in range(0, len(at), BATCH):
                    own.train(all_codes, at[k : k + BATCH], memory)

            for batch in batches:
                for codes, places, sizes in _portions(batch.column(0)):
                    chosen = places[dealt(codes, places, sizes, passes) == step]
                    if len(chosen):
                        waiting.append((codes, chosen))
                        held += len(chosen)
                        seen += len(chosen)
                    if held >= 8 * BATCH:
                        learn()
                        waiting, held = [], 0
            if held:
                learn()
            if seen:
                for at in range(0, _SIZE, 8192):
                    piece = own.flat[at : at + 8192].astype(float) * seen
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(piece), dtype=np.int32)), pa.array(piece), pa.array(np.full(len(piece), seen, np.int64))], ["at", "value", "seen"])

        sums = texts.select("codes").mapInArrow(part, "at int, value double, seen bigint").groupBy("at").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
        found = sums.toArrow()
        if found.num_rows:
            flat = network.flat.astype(float)
            flat[found.column("at").to_numpy()] = found.column("value").to_numpy() / found.column("seen").to_numpy()
            network = Network(flat)
        shared.unpersist()
    return network


def scores(texts: DataFrame, words: Vocabulary, network: Network) -> DataFrame:
    """(row, doc_id, n_words, log_likelihood) of coded texts, so far with the shares that are held: see with_shares()."""
    shared = texts.sparkSession.sparkContext.broadcast(network.flat)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        model = Network(shared.value)
        for batch in batches:
            n, total = [np.zeros(0, np.int64)], [np.zeros(0)]
            for codes, places, sizes in _portions(batch.column("codes")):
                logs = np.concatenate([np.zeros(0), *(model.log_probabilities(codes, places[k : k + STEP_WORDS]) for k in range(0, len(places), STEP_WORDS))])
                n.append(sizes[:, 0])
                total.append(np.bincount(np.repeat(np.arange(len(sizes)), sizes[:, 0]), logs, len(sizes)))
            n, total = np.concatenate(n), np.concatenate(total) + batch.column("held").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["row", "doc_id", "n_words", "log_likelihood"])

    return texts.select("row", "doc_id", "codes", "held").mapInArrow(part, f"row bigint, doc_id {dict(texts.dtypes)['doc_id']}, n_words bigint, log_likelihood double")


def with_shares(found: DataFrame, texts: DataFrame, words: Vocabulary) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood): the shares of all other words are joined from the table of counts and added."""
    if not words.whole:
        totals = F.array([F.lit(float(x)) for x in words.counts[_CLASSES - RARE :]])
        share = F.log(F.col("n") / F.element_at(totals, (F.crc32(F.col("word").cast("binary")) % RARE + 1).cast("int")))
        other = texts.select("row", F.explode("others").alias("word", "k")).join(words.table.select("word", share.alias("share")), "word")
        sums = other.groupBy("row").agg(F.sum(F.col("k") * F.col("share")).alias("more"))
        found = found.join(sums, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return found.select("doc_id", "n_words", "log_likelihood", mean.alias("mean_log_likelihood"))


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", passes: tuple[int, ...] = PASSES) -> DataFrame:
    """Train on the documents and score them: (doc_id, n_words, log_likelihood, mean_log_likelihood) for every row, computed now.

    Texts are split and coded once and kept coded in the shared folder while
    the passes and the scoring read them. Null, empty and blank texts have no
    words, a sum of 0 and a null mean. Equal texts score alike. Empty table:
    no rows.
    """
    spark = docs.sparkSession
    words = vocabulary(docs, text_col)
    path = work_path(spark, "coded")
    coded(docs, words, id_col=id_col, text_col=text_col).write.parquet(path)
    texts = spark.read.parquet(path)
    out = cut(with_shares(scores(texts, words, train(texts, words, passes)), texts, words))
    remove(spark, path)
    return out


def op3_masked_window_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
