"""Quality classifier: a linear-chain conditional random field over lines.

Every line is good or bad. A line is described by its own measures and those
of its neighbours; a chain score links successive labels. Forward-backward
gives each line's probability to be good, and a document's quality is their
mean weighted by line length, put through a logistic fit to the labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from substrata.llm.common import in_arrow, table

#: The model is fitted to so many labelled documents at most, those of the smallest MD5 of their id, and of so many lines each:
#: what the driver fetches is below 4,000 x 400 x 14 numbers. Of longer documents a run of so many lines is taken, drawn by a hash of the text.
TRAIN_DOCUMENTS, TRAIN_LINES = 4_000, 400
FOLDS = 5
THRESHOLD = 0.3
#: Texts are measured in portions of about so many bytes.
PORTION_BYTES = 4 << 20

MEASURES = ("words", "word_length", "upper", "digits", "symbols", "pipes", "shouts", "stops", "distinct", "repeated", "beyond_ascii", "ends", "length")


def _among(characters: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(characters)] = 1
    return out


_UPPER, _LOWER, _DIGIT = _among(bytes(range(65, 91))), _among(bytes(range(97, 123))), _among(bytes(range(48, 58)))
_SPACE, _BEYOND = _among(b" \t\r\x0b\x0c"), _among(bytes(range(128, 256)))
_SYMBOL, _PIPE, _SHOUT, _STOP = _among(b"#$%&*@~^_=+<>{}[]\\/"), _among(b"|"), _among(b"!?"), _among(b".,;:")
_TAIL = _among(bytes(range(128, 192)))  # bytes inside a UTF-8 character


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that aren't blank: document number, measures, length in code points."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sums = lambda lut: np.add.reduceat(lut[data], starts, dtype=np.int64)  # noqa: E731  the line feed counts nowhere
    size = ends - starts
    space = sums(_SPACE)
    solid = size > space
    document = np.searchsorted(np.cumsum([len(c) + 1 for c in coded]), starts, side="right")
    upper, lower, beyond = sums(_UPPER), sums(_LOWER), sums(_BEYOND)
    n = np.maximum(size - space, 1)
    chars = size - sums(_TAIL)
    words, distinct, repeated, last = (np.zeros(len(ends)) for _ in range(4))
    at = 0
    for c in coded:
        lines = c.split(b"\n")
        seen: dict[bytes, int] = {}
        for line in lines:
            seen[line] = seen.get(line, 0) + 1
        for k, line in enumerate(lines, at):
            split = line.split()
            if split:
                words[k], distinct[k] = len(split), len(set(split)) / len(split)
                repeated[k] = (seen[line] - 1) / len(lines)
                last[k] = split[-1][-1] in b".!?:;\"'"
        at += len(lines)
    share = lambda x: x / n
    some = np.maximum(words, 1)
    x = np.stack([
        np.log1p(words), np.minimum(n / some, 60) / 10, upper / np.maximum(upper + lower, 1), share(sums(_DIGIT)), share(sums(_SYMBOL)), sums(_PIPE) / some, sums(_SHOUT) / some,
        sums(_STOP) / some, distinct, repeated, share(beyond), last, np.log1p(chars),
    ], 1)
    return document[solid], x[solid], np.maximum(chars, 1)[solid].astype(float)


def with_neighbours(document: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Own measures, those of the line before and of the line after (zeros at the ends of a document), and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        same = (document[1:] == document[:-1])[:, None]
        before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    return np.concatenate([x, before, after, np.ones((len(x), 1))], 1)


@dataclass
class Chains:
    """Lines of several documents, the longest document first, so that those still going on are always the first ones."""

    first: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, document: np.ndarray) -> Chains:
        first = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]])) if len(document) else np.zeros(0, int)
        count = np.diff(np.concatenate([first, [len(document)]]))
        order = np.argsort(-count, kind="stable")
        return cls(first[order], count[order])

    def live(self) -> Iterator[tuple[int, np.ndarray]]:
        for t in range(int(self.count[0]) if len(self.count) else 0):
            yield t, self.first[: np.searchsorted(-self.count, -t, side="left")] + t


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + np.squeeze(top, axis)


def forward_backward(emission: np.ndarray, link: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (lines, 2) of labels bad and good, expected links (2, 2) and log partition of each chain."""
    score = np.stack([np.zeros_like(emission), emission], 1)
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    steps = list(chains.live())
    for t, rows in steps:
        alpha[rows] = score[rows] if t == 0 else score[rows] + _logsum(alpha[rows - 1][:, :, None] + link, 1)
    for t, rows in reversed(steps):
        if t:
            beta[rows - 1] = _logsum(link + (score[rows] + beta[rows])[:, None, :], 2)
    partition = _logsum(alpha[chains.first + chains.count - 1], 1) if len(chains.first) else np.zeros(0)
    total = _logsum(alpha + beta, 1)
    marginal = np.exp(alpha + beta - total[:, None])
    links = np.zeros((2, 2))
    inner = np.concatenate([rows for t, rows in steps if t] or [np.zeros(0, int)])
    if len(inner):
        joint = alpha[inner - 1][:, :, None] + link + (score[inner] + beta[inner])[:, None, :]
        links = np.exp(joint - total[inner][:, None, None]).sum(0)
    return marginal, links, partition


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    link: np.ndarray
    slope: float
    shift: float

    def features(self, document: np.ndarray, x: np.ndarray) -> np.ndarray:
        return with_neighbours(document, np.clip((x - self.mean) / self.scale, -4, 4))

    def raw(self, document: np.ndarray, x: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
        """Length-weighted mean marginal of each of n documents, as log odds; NaN of those without lines."""
        marginal, _, _ = forward_backward(self.features(document, x) @ self.weights, self.link, Chains.of(document))
        weight = np.bincount(document, length, n)
        good = np.bincount(document, length * marginal[:, 1], n) / np.where(weight, weight, np.nan)
        good = np.clip(good, 1e-6, 1 - 1e-6)
        return np.log(good / (1 - good))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Documents without a line that isn't blank get the score of even odds between good and bad lines."""
        out, at = np.empty(len(texts)), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < PORTION_BYTES):
                size += len(texts[to] or "")
                to += 1
            out[at:to] = self.raw(*measure(texts[at:to]), to - at)
            at = to
        return 1 / (1 + np.exp(-(self.slope * np.nan_to_num(out) + self.shift)))


def fit(document: np.ndarray, x: np.ndarray, length: np.ndarray, label: np.ndarray, *, steps: int = 80, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Fit by Adam on the mean log likelihood a line, each line labelled as its document; label: by document, 0 or 1."""
    if len(x) == 0 or label.min() == label.max():  # nothing to tell apart
        width = len(MEASURES)
        prior = float(np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99))
        return Model(np.zeros(width), np.ones(width), np.zeros(3 * width + 1), np.zeros((2, 2)), 1.0, float(np.log(prior / (1 - prior))))
    model = Model(x.mean(0), x.std(0) + 1e-6, np.zeros(3 * x.shape[1] + 1), np.zeros((2, 2)), 1.0, 0.0)
    features, chains, lines = model.features(document, x), Chains.of(document), label[document].astype(int)
    seen = np.zeros((2, 2))
    same = document[1:] == document[:-1]
    np.add.at(seen, (lines[:-1][same], lines[1:][same]), 1)
    target = features.T @ lines
    theta = np.zeros(features.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        marginal, links, _ = forward_backward(features @ theta[:-4], theta[-4:].reshape(2, 2), chains)
        slope = np.concatenate([target - features.T @ marginal[:, 1], (seen - links).ravel()]) / len(lines) - decay * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model.weights, model.link = theta[:-4], theta[-4:].reshape(2, 2)
    odds = model.raw(document, x, length, len(label))
    known = ~np.isnan(odds)
    z, y = np.stack([odds[known], np.ones(known.sum())], 1), label[known].astype(float)
    w = np.array([1.0, 0.0])
    for _ in range(30):  # Newton's method, held back a little
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (y - p) - 1e-2 * (w - [1.0, 0.0]))
    model.slope, model.shift = max(float(w[0]), 1e-3), float(w[1])
    return model


def remainder(id_col: str | Column) -> Column:
    return F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit to the labelled documents of which the remainder isn't 0.

    Null labels and ids are left out. Of several labels of one document the
    lowest holds. The rows fetched are the measures of at most TRAIN_DOCUMENTS
    x TRAIN_LINES lines, as arrays; of a document of more lines a run of them.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").where(remainder("id") != 0)
    chosen = chosen.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.md5(F.col("id").cast("string")), "id").limit(TRAIN_DOCUMENTS)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "label", "text")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("text").to_pylist()
            for k, text in enumerate(values):
                document, x, length = measure([text])
                if len(document) > TRAIN_LINES:
                    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % (len(document) - TRAIN_LINES + 1)
                    x, length = x[at : at + TRAIN_LINES], length[at : at + TRAIN_LINES]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(k, 1), batch.column("label").slice(k, 1), pa.array([x.ravel().tolist()], pa.list_(pa.float64())), pa.array([length.tolist()], pa.list_(pa.float64()))], ["id", "label", "x", "length"])

    kind = dict(texts.dtypes)["id"]
    rows = in_arrow(texts, part, f"id {kind}, label int, x array<double>, length array<double>").toArrow()
    rows = rows.sort_by([("id", "ascending")])  # the fit doesn't depend on the order in which tasks end
    x, length = (np.concatenate([np.zeros(0), *(chunk.flatten().to_numpy() for chunk in rows.column(c).chunks)]) for c in ("x", "length"))
    document = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("length")).to_numpy()) if rows.num_rows else np.zeros(0, int)
    return fit(document, x.reshape(-1, len(MEASURES)), length, np.array(rows.column("label").to_pylist(), float))


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Return (doc_id, held_out, score, predicted) for every row.

    Null texts score as empty ones, and all texts without a line that isn't
    blank alike. Rows of equal text score alike, whatever their id; repeated
    rows each have a row; a row without an id isn't held out. A score of the
    threshold is predicted 1. Texts are read whole. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(remainder(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return in_arrow(rows, part, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least the threshold, with all their columns, repeated ones as often. Nulls, ties, long texts and empty tables: see score_documents()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(place).to_pylist()) >= threshold))

    return in_arrow(docs, part, docs.schema)


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
