"""Learned estimators of approximate substring counts, behind one interface.

They train on the driver from a count table, of which MOST_ROWS rows at most
are fetched, those of the smallest hash; scoring runs in Arrow batches on the
executors. All of them work on ln(1 + count), cut estimates to 0..n and never
let an estimate fall with the threshold.
"""

from __future__ import annotations

import abc
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from substrata.functions import text as T
from substrata.operators import lbs, metrics, sampling
from substrata.plans.autodiff import Node, Parameters, joined
from substrata.sources.work import cut

MOST_ROWS = 200_000
EPOCHS, PATIENCE, BATCH = 30, 6, 256


def q_errors(y: np.ndarray, e: np.ndarray) -> np.ndarray:
    y, e = np.maximum(y, 1), np.maximum(e, 1)
    return np.maximum(y / e, e / y)


class Estimator(abc.ABC):
    """n: how many strings the database has."""

    def __init__(self, n: int):
        self.n = n

    @abc.abstractmethod
    def fit(self, train: DataFrame, valid: DataFrame) -> Estimator:
        """Learn from (q, delta, card)."""

    @abc.abstractmethod
    def transform(self, rows: DataFrame) -> DataFrame:
        """(q, delta) -> (q, delta, estimate)."""


class Boosted(Estimator):
    """Gradient-boosted trees of Spark ML, trained on the executors."""

    def fit(self, train: DataFrame, valid: DataFrame) -> Boosted:
        stages = [HashingTF(inputCol="grams", outputCol="bag", numFeatures=64), VectorAssembler(inputCols=["len", "delta", "bag"], outputCol="features"), GBTRegressor(labelCol="y", maxIter=40, maxDepth=5, seed=0)]
        self.model = Pipeline(stages=stages).fit(self._features(train.unionByName(valid)).withColumn("y", F.log1p(F.col("card").cast("double"))))
        return self

    @staticmethod
    def _features(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"grams": F.concat(T.chars("q"), T.qgrams("q", 2)), "len": F.length("q")})

    def transform(self, rows: DataFrame) -> DataFrame:
        """An estimate is the largest prediction up to the threshold."""
        steps = rows.select("q", "delta", F.explode(F.sequence(F.lit(0), F.col("delta"))).alias("upto"))
        found = self.model.transform(self._features(steps.select("q", F.col("upto").alias("delta"), F.col("delta").alias("of"))))
        value = F.least(F.greatest(F.expm1("prediction"), F.lit(0.0)), F.lit(float(self.n)))
        return found.groupBy("q", F.col("of").alias("delta")).agg(F.max(value).alias("estimate"))


class PatternStatistics(Estimator):
    """Wildcard n-gram statistics of the strings themselves; what it learns from counts is its coverage.

    strings: (rid, s). The table of n-grams is built once, at the first fit.
    """

    def __init__(self, n: int, strings: DataFrame, ngram: int = lbs.NGRAM, least: int = lbs.LEAST, hashes: int = lbs.HASHES):
        super().__init__(n)
        self.strings, self.ngram, self.least, self.hashes = strings, ngram, least, hashes
        self.table: DataFrame | None = None
        self.coverage = 1.0

    def fit(self, train: DataFrame, valid: DataFrame) -> PatternStatistics:
        if self.table is None:
            self.table = cut(lbs.build(self.strings, self.ngram, self.least, self.hashes))
        self.coverage = lbs.coverage(train.unionByName(valid), self.table, n=self.ngram, hashes=self.hashes)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        found = lbs.estimate(rows.select("q", "delta").distinct(), self.table, self.coverage, self.ngram, self.hashes)
        kept = F.least(F.col("estimate"), F.lit(float(self.n)))
        return rows.select("q", "delta").join(found.select("q", "delta", kept.alias("estimate")), ["q", "delta"])


class Neural(Estimator):
    """A network over encoded strings; subclasses say which.

    Its widths are those of the longest query and the largest threshold that
    it is fitted to, or of larger ones given. Beyond them it has no estimate
    and says so; the recurrent network reads queries of any length.
    """

    rate = 4e-3
    any_length = False

    def __init__(self, n: int, most_length: int = 1, most_delta: int = 0):
        super().__init__(n)
        self.width, self.most_delta = most_length, most_delta
        self.parameters = Parameters(seed=0)
        self.alphabet: dict[str, int] = {}

    @abc.abstractmethod
    def predict(self, ids: np.ndarray, length: np.ndarray) -> Node:
        """ln(1 + count) for each threshold: (rows, most_delta + 1)."""

    def extra_loss(self) -> Node | float:
        return 0.0

    def prepare(self, queries: list[str]) -> None:
        """Before training."""

    def encode(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids from 2 (0 pads, 1 is unknown) of whole queries, and lengths."""
        length = np.array([len(q) for q in queries], np.int64)
        longest = int(length.max(initial=0))
        if longest > self.width and not self.any_length:
            raise ValueError(f"a query of {longest} characters; the model was fitted for up to {self.width}")
        ids = np.zeros((len(queries), max(longest, self.width)), np.int64)
        for k, q in enumerate(queries):
            ids[k, : len(q)] = [self.alphabet.get(x, 1) for x in q]
        return ids, length

    @staticmethod
    def _fetch(rows: DataFrame) -> pd.DataFrame:
        return rows.select("q", "delta", "card").orderBy(F.md5(F.concat_ws(":", "q", "delta")), "q", "delta").limit(MOST_ROWS).toPandas()

    def fit(self, train: DataFrame, valid: DataFrame) -> Neural:
        train, valid = self._fetch(train), self._fetch(valid)
        self.alphabet = {x: k for k, x in enumerate(sorted(set("".join(train.q))), 2)}
        if not len(train):
            return self
        for rows in (train, valid):
            if len(rows):
                self.width, self.most_delta = max(self.width, int(rows.q.str.len().max())), max(self.most_delta, int(rows.delta.max()))
        self.prepare(sorted(set(train.q)))
        ids, length = self.encode(list(train.q))
        delta, y = train.delta.to_numpy(), np.log1p(train.card.to_numpy(float))
        random, best, left = np.random.default_rng(1), (np.inf, None), PATIENCE
        for _ in range(EPOCHS):
            order = random.permutation(len(y))
            for at in range(0, len(y), BATCH):
                k = order[at : at + BATCH]
                found = self.predict(ids[k], length[k])[np.arange(len(k)), delta[k]]
                self.parameters.step((found - y[k]).square().mean() + self.extra_loss(), self.rate)
            judged = valid if len(valid) else train
            error = q_errors(judged.card.to_numpy(float), self.estimates(list(judged.q), judged.delta.to_numpy())).mean()
            best, left = ((error, self.parameters.copy_values()), PATIENCE) if error < best[0] else (best, left - 1)
            if not left:
                break
        self.parameters.restore(best[1])
        return self

    def estimates(self, queries: list[str], delta: np.ndarray) -> np.ndarray:
        if not queries:
            return np.zeros(0)
        if (most := int(np.max(delta))) > self.most_delta:
            raise ValueError(f"a threshold of {most}; the model was fitted for up to {self.most_delta}")
        ids, length = self.encode(queries)
        out = np.concatenate([np.maximum.accumulate(self.predict(ids[k : k + 2048], length[k : k + 2048]).value, 1) for k in range(0, len(queries), 2048)])
        return np.clip(np.expm1(np.minimum(out[np.arange(len(queries)), delta], 50)), 0, self.n)

    def transform(self, rows: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((type(self), (self.n, self.width, self.most_delta), self.alphabet, self.parameters.copy_values(), self.state()))

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kind, sizes, alphabet, values, state = shared.value
            model = kind(*sizes)
            model.alphabet = alphabet
            model.__dict__.update(state)
            model.parameters.update({k: Node(v) for k, v in values.items()})
            for f in frames:
                yield f.assign(estimate=model.estimates(list(f.q), f.delta.to_numpy()))

        return rows.select("q", "delta").mapInPandas(part, "q string, delta int, estimate double")

    def state(self) -> dict:
        return {}

    def per_threshold(self, x: Node, name: str, size: int) -> Node:
        """A small network applied to x joined with the embedding of each threshold."""
        p, rows = self.parameters, x.value.shape[0]
        table = p.weight(f"{name}.delta", self.most_delta + 1, 5)
        out = []
        for d in range(self.most_delta + 1):
            both = joined([x, table[np.full(rows, d)]])
            h = p.dense(f"{name}.1", both, size).leaky()
            h = p.dense(f"{name}.2", h, size).leaky()
            out.append(p.dense(f"{name}.3", h, 1))
        return joined(out)


class Sequence(Neural):
    """Character embeddings through a recurrent network with gates, then a network with the threshold's embedding."""

    size, any_length = 32, True

    def predict(self, ids: np.ndarray, length: np.ndarray) -> Node:
        p, n = self.parameters, self.size
        rows = len(ids)
        table = p.weight("chars", max(len(self.alphabet) + 2, 2), 12, scale=0.3)
        h, c = Node(np.zeros((rows, n))), Node(np.zeros((rows, n)))
        for t in range(int(length.max()) if rows else 0):
            gates = p.dense("lstm", joined([table[ids[:, t]], h]), 4 * n)
            i, f, o, g = gates[:, :n].sigmoid(), (gates[:, n : 2 * n] + 1.0).sigmoid(), gates[:, 2 * n : 3 * n].sigmoid(), gates[:, 3 * n :].tanh()
            on = (t < length).astype(float)[:, None]
            new = f * c + i * g
            c = new * on + c * (1 - on)
            h = (o * new.tanh()) * on + h * (1 - on)
        return self.per_threshold(h, "out", 32)


class Monotone(Neural):
    """Shifted character bits and a variational code of them; steps that are never negative are summed over thresholds."""

    code, tau, weight = 16, 2, 0.01

    def bits(self, ids: np.ndarray) -> np.ndarray:
        """For each character at place p the bits p..p + 2 tau of its block."""
        width = self.width + 2 * self.tau
        out = np.zeros((len(ids), (len(self.alphabet) + 2) * width))
        row, at = np.nonzero(ids)
        for shift in range(2 * self.tau + 1):
            out[row, ids[row, at] * width + at + shift] = 1
        return out

    def predict(self, ids: np.ndarray, length: np.ndarray) -> Node:
        p, x = self.parameters, Node(self.bits(ids))
        h = p.dense("encode", x, 64).leaky()
        mean, spread = p.dense("mean", h, self.code), p.dense("spread", h, self.code)
        drawn = mean + (spread * 0.5).exp() * p.random.normal(0, 1, mean.value.shape) * (0.1 if p.steps else 0.0)
        back = p.dense("decode", p.dense("decode.1", drawn, 64).leaky(), x.value.shape[1])
        cross = (back.softplus() - back * x.value).mean()
        divergence = (spread.exp() + mean.square() - spread - 1.0).mean() * 0.5
        self._extra = (cross + divergence * 0.1) * self.weight
        steps = self.per_threshold(joined([drawn, h, p.dense("bits", x, 32).leaky(), Node(length[:, None] / self.width)]), "step", 32)
        return steps.softplus().cumsum()

    def extra_loss(self) -> Node:
        return self._extra

    def estimates(self, queries: list[str], delta: np.ndarray) -> np.ndarray:
        steps, self.parameters.steps = self.parameters.steps, 0  # without noise
        out = super().estimates(queries, delta)
        self.parameters.steps = steps
        return out


class Embedded(Neural):
    """A convolutional embedding trained on triplets of a prefix tree, then a network on the embeddings for each threshold."""

    size, margin, rounds = 24, 0.2, 60

    def embed(self, ids: np.ndarray) -> Node:
        """Convolutions of width 3 with pooling by pairs over one-hot characters, then a dense layer."""
        p, rows = self.parameters, len(ids)
        x = p.weight("conv.chars", len(self.alphabet) + 2, 16, scale=0.3)[ids]
        for k in range(2):
            wide = x.value.shape[1]
            edge = Node(np.zeros((rows, 1, x.value.shape[2])))
            x = joined([edge, x, edge], 1)
            x = p.dense(f"conv.{k}", joined([x[:, j : j + wide] for j in range(3)], 2), 16).relu()
            x = (x[:, 0 : wide - wide % 2 : 2] + x[:, 1 : wide : 2]) * 0.5
        return p.dense("conv.out", x.reshape(rows, -1), self.size)

    def prepare(self, queries: list[str]) -> None:
        """Triplets: a string, its parent or a child in the tree, any other string."""
        known = set(queries)
        pairs = [(q, q[:-1]) for q in queries if q[:-1] in known] or [(q, q) for q in queries]
        random = np.random.default_rng(2)
        for _ in range(self.rounds):
            chosen = random.integers(0, len(pairs), 128)
            others = random.integers(0, len(queries), 128)
            a, b, c = (self.embed(self.encode(list(s))[0]) for s in ([pairs[k][0] for k in chosen], [pairs[k][1] for k in chosen], [queries[k] for k in others]))
            near, far = (a - b).square().sum(1), (a - c).square().sum(1)
            self.parameters.step((near - far + self.margin).relu().mean(), 2e-3)

    def predict(self, ids: np.ndarray, length: np.ndarray) -> Node:
        x = joined([self.embed(ids), Node(length[:, None] / self.width)])
        return self.per_threshold(x, "selectivity", 32)


ESTIMATORS: dict[str, type[Estimator]] = {"boosted": Boosted, "sequence": Sequence, "monotone": Monotone, "embedded": Embedded}


def evaluate(name: str, truth: DataFrame, n: int, *, p_test: float = 0.1, p_valid: float = 0.1, seed: str = "0", strings: DataFrame | None = None) -> DataFrame:
    """Fit to the training split of the queries in (q, delta, card) and estimate the test split: (q, delta, card, estimate, q_err, q_err_eps, log10_err, msle).

    strings: (rid, s), which the estimator "patterns" needs.
    """
    if name not in ESTIMATORS and name != "patterns":
        raise ValueError(f"no estimator {name!r}; there are {', '.join([*ESTIMATORS, 'patterns'])}")
    if name == "patterns" and strings is None:
        raise ValueError("the estimator 'patterns' needs the strings")
    split = sampling.three_way(truth.select("q").distinct(), p_test=p_test, p_valid=p_valid, seed=seed)
    rows = truth.select("q", "delta", "card").join(split, "q").persist()
    part = lambda s: rows.where(F.col("split") == s).select("q", "delta", "card")
    model, test = PatternStatistics(n, strings) if name == "patterns" else ESTIMATORS[name](n), part("test")
    if isinstance(model, Neural):  # queries and thresholds to come may be larger than those of the training split
        most = rows.agg(F.max(F.length("q")).alias("length"), F.max("delta").alias("delta")).first()
        model.width, model.most_delta = most.length or 1, most.delta or 0
    model.fit(part("train"), part("valid"))
    return metrics.with_errors(test.join(model.transform(test.select("q", "delta")), ["q", "delta"]))


def latency(model: Estimator, rows: DataFrame, k: int = 100) -> float:
    """Mean seconds an estimate takes, of k rows scored one at a time in this process."""
    few = rows.select("q", "delta").limit(k).toPandas()
    if not isinstance(model, Neural) or not len(few):
        began = time.perf_counter()
        model.transform(rows.limit(k)).count()
        return (time.perf_counter() - began) / max(len(few), 1)
    began = time.perf_counter()
    for q, d in zip(few.q, few.delta, strict=True):
        model.estimates([q], np.array([d]))
    return (time.perf_counter() - began) / len(few)
