"""Toxicity: a chain of linear models, each of which sees the probabilities of the categories before it.

Later models are trained with out-of-fold probabilities: what a model that has not seen a document says of it, as it will be for new texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named
from .features import Features, dot
from .training import Sample, logistic, sample, sigmoid


@dataclass(frozen=True)
class ChainSpec:
    """most_rows bounds the training sample; the rarer class weighs up to `balance` times as much. The first category covers the
    others, whose models see what the ones before them say of it."""

    categories: tuple[str, ...] = ("toxic", "toxic_prose", "toxic_noise")
    most_rows: int = 5000
    folds: int = 4
    balance: float = 4.0
    l2: float = 1e-4
    threshold: float = 0.5
    features: Features = field(default_factory=lambda: Features(bits=19, prefixes=(4, 5, 6)))


@dataclass(frozen=True)
class Link:
    """One category's model: weights by feature, one for each category before it, and a constant."""

    weights: np.ndarray
    before: np.ndarray
    constant: float

    def p(self, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return sigmoid(x + earlier @ self.before + self.constant)


def _evidence(s: Sample, d: int, weight: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How much each feature's presence differs between the classes, against its standard error, scaled so that rows have a mean square
    of 1. As factors of the values these let features with evidence take weight first; none is left out."""
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    a, b = np.bincount(s.feature, (weight * y)[s.row], d) / n1, np.bincount(s.feature, (weight * (1 - y))[s.row], d) / n0
    z = np.abs(a - b) / np.sqrt(a * (1 - a) / n1 + b * (1 - b) / n0 + (0.5 / n1) ** 2)
    mean = (weight[s.row] * (s.value * z[s.feature]) ** 2).sum() / weight.sum()
    return z / np.sqrt(mean) if mean else np.ones(d)


def _fit(s: Sample, d: int, y: np.ndarray, earlier: np.ndarray, rows: np.ndarray, spec: ChainSpec) -> Link:
    """Weighted logistic regression on the rows that `rows` marks."""
    n, share = int(rows.sum()), float(y[rows].mean()) if rows.any() else 0.0
    if share in (0.0, 1.0):  # nothing to tell apart
        return Link(np.zeros(d), np.zeros(earlier.shape[1]), float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5))))
    weight = np.where(y > 0, min(spec.balance, (1 - share) / share), 1.0) * rows
    weights, more = logistic(s, d, earlier, y, weight / weight.sum(), _evidence(s, d, rows.astype(float), y), spec.l2)
    return Link(weights, more[:-1], float(more[-1]))


def fit_chain(full: Sample, spec: ChainSpec) -> list[Link]:
    """A model for each category, in order. Without rows all probabilities are 1/2, and nothing is over a threshold above that."""
    names, s = full.compact()
    n, d = len(s), len(names)
    fold = np.arange(n) % spec.folds  # rows come by hash
    earlier = np.zeros((n, 0))
    out = []
    for c in range(len(spec.categories)):
        y = s.targets[:, c]
        link = _fit(s, d, y, earlier, np.ones(n, bool), spec)
        weights = np.zeros(1 << spec.features.bits, np.float32)
        weights[names] = link.weights
        out.append(Link(weights, link.before, link.constant))
        if c + 1 == len(spec.categories):
            break
        unseen = np.zeros(n)
        for f in range(spec.folds):
            part = _fit(s, d, y, earlier, fold != f, spec)
            p = part.p(dot(s.row, s.feature, s.value, part.weights, n), earlier)
            unseen[fold == f] = p[fold == f]
        earlier = np.column_stack([earlier, unseen])
    return out


def categories(labels: DataFrame) -> DataFrame:
    """doc_id and the marks of the chain: toxic, which covers the others; toxic in good prose; toxic in noise (bad quality)."""
    toxic, good = F.col("toxic"), F.col("quality")
    return labels.select("doc_id", toxic.alias("toxic"), (toxic * good).alias("toxic_prose"), (toxic * (1 - good)).alias("toxic_noise"))


def train(docs: DataFrame, marked: DataFrame, spec: ChainSpec = ChainSpec(), *, text: str = "text", doc_id: str = "doc_id") -> list[Link]:
    return fit_chain(sample(docs, marked, list(spec.categories), spec.features, spec.most_rows, text=text, doc_id=doc_id), spec)


def probabilities(texts: list[str | None], chain: list[Link], spec: ChainSpec) -> np.ndarray:
    """A column for each category. The first covers the others, so it is as likely as the likeliest of them, whatever its own
    model says: the verdict on it is that of the whole chain."""

    def of(row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for link in chain:
            out = np.column_stack([out, link.p(dot(row, feature, value, link.weights, n), out)])
        out[:, 0] = out.max(axis=1)
        return out

    return spec.features.each(texts, of)


def score(docs: DataFrame, chain: list[Link], spec: ChainSpec = ChainSpec(), *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, p_<category> for each category, and flagged (the first, which is as likely as the likeliest, is over the threshold), for every row of `docs`.

    A null text counts as empty; texts without words score by the constants alone. Ids may be null or repeated; every row is
    scored by itself, over its whole text; a probability at the threshold is not over it. An empty table gives no rows; other columns are not read.
    """
    names = ["doc_id", *(f"p_{c}" for c in spec.categories), "flagged"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = probabilities(b.column(1).to_pylist(), chain, spec)
            cols = [pa.array(c) for c in p.T] + [pa.array(p[:, 0] > spec.threshold)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    src = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in names[1:-1]) + ", flagged boolean")
