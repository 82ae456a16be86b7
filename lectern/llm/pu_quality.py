"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; all else it learns from is text without labels.  A
first classifier of positives against unlabelled text gives the class prior (the best upper bound, over bins, of the share of
positives in the unlabelled text).  A small network then minimises the non-negative unbiased risk
prior * R+(P) + max(0, R-(U) - prior * R-(P)).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import bounded_sample, checkpointed, read, text_key

#: At most so many trusted positives and so many unlabelled documents are fitted on.
MAX_POSITIVES = 4000
MAX_UNLABELLED = 8000
THRESHOLD = 0.7
HIDDEN = 24
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def _without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


FEATURES = 16


def features(text: str | None) -> list[float]:
    """How a text is written, whatever its language: lengths, kinds of characters, repetition."""
    data = (text or "").encode()
    words, n_bytes = data.split(), max(1, len(data))
    n = max(1, len(words))
    letters = _without(data, _LETTERS)
    lines = [x for x in data.split(b"\n") if x]
    n_lines = max(1, len(lines))
    return [
        np.log1p(len(words)),
        np.log1p(n_bytes / n_lines),
        sum(map(len, words)) / n,
        len(set(words)) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2),
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / n_lines,
        _without(data, _LETTERS[:26]) / max(1, letters),
        letters / n_bytes,
        _without(data, bytes(range(128, 256))) / n_bytes,
        _without(data, b"0123456789") / n_bytes,
        _without(data, b"#*$%&|<>") / n,
        _without(data, b"!?") / n,
        _without(data, b".,;:") / n,
        _without(data, b"()[]{}\"'-_/=+@") / n,
        len(zlib.compress(data, 1)) / n_bytes,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """One hidden layer over standardised features, fitted by Adam."""

    def __init__(self, x: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        d = x.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t, self.rng = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0, rng

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def step(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray, rate: float) -> None:
        """Descends along d(loss)/d(output) = ``slope``."""
        back = slope[:, None] * self.p[2] * (1 - h * h)
        grads = [z.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]
        self.t += 1
        for i, g in enumerate(grads):
            g = g + 1e-4 * self.p[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = self.p[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.standard(x))[1])


def risk_slopes(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes, by the network's outputs, of what a step descends along; ``p`` and ``u`` are the scores of positives and unlabelled texts.

    That is the unbiased risk prior * R+(P) + (R-(U) - prior * R-(P)), or where its last part has fallen below zero the part's reverse, which undoes the overfit.
    """
    dp, du = p * (1 - p) / len(p), u * (1 - u) / len(u)  # of the loss of calling a text negative; that of calling it positive falls as this rises
    if u.mean() < prior * p.mean():
        return prior * dp, -du
    return -2 * prior * dp, du


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, rounds: int = 1500) -> Network:
    """Without a prior: positives against unlabelled, log loss.  With one: non-negative unbiased risk, sigmoid loss."""
    net = Network(np.concatenate([positive, unlabelled]))
    zp, zu = net.standard(positive), net.standard(unlabelled)
    for _ in range(rounds):
        a, b = zp[net.rng.integers(0, len(zp), 256)], zu[net.rng.integers(0, len(zu), 512)]
        z = np.concatenate([a, b])
        h, g = net.forward(z)
        s = _sigmoid(g)
        p, u = s[: len(a)], s[len(a) :]
        net.step(z, h, np.concatenate([(p - 1) / len(a), u / len(b)] if prior is None else risk_slopes(p, u, prior)), 0.01)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled texts, from scores of a classifier that tells the two apart.

    Above any threshold the unlabelled share is at least prior * the positive share; the least ratio, with room for
    sampling error, is the estimate.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.quantile(p, np.linspace(0.02, 0.6, 59))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    error = np.sqrt(np.log(400) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((above_u + error) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Network, float]:
    """The classifier and the class prior; features of trusted positives and of unlabelled documents."""
    if not len(positive) or not len(unlabelled):
        raise ValueError("no positives or no unlabelled documents to learn from")
    # scored on documents that the first classifier has not seen, or it would take memory for difference
    a, b = slice(0, None, 2), slice(1, None, 2) if min(len(positive), len(unlabelled)) > 1 else slice(0, None, 2)
    first = _fit(positive[a], unlabelled[a], None, 600)
    prior = class_prior(first.score(positive[b]), first.score(unlabelled[b]))
    return _fit(positive, unlabelled, prior), prior


def _featured(docs: DataFrame, columns: list[str]) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[columns].assign(x=[features(t) for t in pdf["text"]])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.mapInPandas(work, f"{schema}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[Network | None, float]:
    """Learns from rows with ``learn`` (over doc_id); labels are read of positives only.  (None, 0.5) if there are none."""
    trusted = bounded_sample(labels.where((F.col("quality") == 1) & learn & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "doc_id", MAX_POSITIVES)
    others = bounded_sample(docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "doc_id", MAX_UNLABELLED)
    chosen = checkpointed(trusted.select("doc_id", F.lit(1).alias("p")).union(others.select("doc_id", F.lit(0))).groupBy("doc_id").agg(F.max("p").alias("p"), (F.min("p") == 0).alias("u")))
    # one row an id, so MAX_POSITIVES + MAX_UNLABELLED rows at most: the text of the lowest hash where rows share an id
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "p", "u").agg(F.min_by("text", text_key(F.col("text"))).alias("text"))
    rows = _featured(sample, ["p", "u"]).toPandas()
    x = np.array(rows["x"].tolist()).reshape(-1, FEATURES)
    order = np.lexsort(x.T)  # the same fit in whatever order the rows arrive
    x, p, u = x[order], rows["p"].to_numpy()[order] == 1, rows["u"].to_numpy()[order]
    return fit(x[p], x[u]) if p.any() and u.any() else (None, 0.5)


def score(docs: DataFrame, model: Network | None, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of every row of ``docs`` and the score from the whole text, in column ``name``; null texts score as empty ones.

    Without a model every score is 0.5.
    """
    if model is None:
        return docs.select(*columns, F.lit(0.5).alias(name))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([features(t) for t in pdf["text"]]).reshape(-1, FEATURES)
            yield pdf[columns].assign(**{name: model.score(x)})

    return docs.mapInPandas(work, T.StructType([*(docs.schema[c] for c in columns), T.StructField(name, T.DoubleType())]))


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    model, _ = train(docs, labels, fold("doc_id", 4) != 2)
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
