"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(t_k - w.x): one set of hashed-text weights w for all grades, and ordered thresholds t_0 < t_1 < ...
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, rows_in_arrow
from .features import Features, dot
from .training import Sample, adam, sample, sigmoid


@dataclass(frozen=True)
class QualitySpec:
    """most_rows bounds the training sample. A document is selected if P(grade >= keep_grade) is keep_p or more."""

    grades: int = 3
    most_rows: int = 4096
    steps: int = 200
    rate: float = 0.3
    l2: float = 1e-4
    keep_grade: int = 1
    keep_p: float = 0.5
    features: Features = field(default_factory=lambda: Features(bits=16, prefixes=(4,)))


@dataclass(frozen=True)
class Ordinal:
    """A fitted model: weights by feature, thresholds by grade."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each linear score."""
        return sigmoid(x[:, None] - self.thresholds[None, :])


def fit_ordinal(s: Sample, spec: QualitySpec) -> Ordinal:
    """Grades are the sample's first target. Without rows the weights are 0 and all grades equally likely."""
    k, d, n = spec.grades, 1 << spec.features.bits, max(1, len(s))
    even = np.log(np.arange(1, k) / np.arange(k - 1, 0, -1))
    start = np.concatenate([np.zeros(d), even[:1], np.log(np.diff(even))])
    if not len(s):
        return Ordinal(np.zeros(d), even)
    y = np.clip(s.targets[:, 0].astype(int), 0, k - 1)

    def thresholds(p: np.ndarray) -> np.ndarray:
        return p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])

    def slope(p: np.ndarray) -> np.ndarray:
        t = np.concatenate([[-np.inf], thresholds(p), [np.inf]])
        x = dot(s.row, s.feature, s.value, p[:d], len(s))
        hi, lo = sigmoid(t[y + 1] - x), sigmoid(t[y] - x)
        d_hi, d_lo, mass = hi * (1 - hi), lo * (1 - lo), np.maximum(hi - lo, 1e-12)
        g = np.empty_like(p)
        g[:d] = np.bincount(s.feature, s.value * ((d_hi - d_lo) / mass)[s.row], d) / n + spec.l2 * p[:d]
        by = np.bincount(y, -d_hi / mass, k)[: k - 1] + np.bincount(y, d_lo / mass, k)[1:]
        after = np.cumsum(by[::-1])[::-1] / n  # a step up of one threshold lifts all above it
        g[d] = after[0]
        g[d + 1 :] = after[1:] * np.exp(p[d + 1 :])
        return g

    p = adam(slope, start, spec.steps, spec.rate)
    return Ordinal(p[:d], thresholds(p))


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade: how fit a document is for training, as one scale made of the two marks that a rater gave.

    0, unfit: of bad quality, be it toxic or not, as nothing can be learnt from noise. 1, fit with reservations: good but toxic.
    2, fit: good and clean. Each step up asks for all that the step before asks for, which is what makes the scale ordinal.
    """
    grade: Column = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    grade = F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), grade)
    return labels.select("doc_id", grade.alias("grade"))


def train(docs: DataFrame, graded: DataFrame, spec: QualitySpec = QualitySpec(), *, text: str = "text", doc_id: str = "doc_id") -> Ordinal:
    return fit_ordinal(sample(docs, graded, ["grade"], spec.features, spec.most_rows, text=text, doc_id=doc_id), spec)


def linear(texts: list[str | None], model: Ordinal, spec: QualitySpec) -> np.ndarray:
    return spec.features.each(texts, lambda row, feature, value, n: dot(row, feature, value, model.weights, n))


def score(docs: DataFrame, model: Ordinal, spec: QualitySpec = QualitySpec(), *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, expected_grade, p_tail (of keep_grade), grade (likeliest) and selected, for every row of `docs`.

    A null text counts as empty; texts without words score by the thresholds alone. Ids may be null or repeated; every row is
    scored by itself, over its whole text. Ties between grades go to the lower one. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = linear(b.column(1).to_pylist(), model, spec)
            tails = model.tails(x)
            p = tails[:, spec.keep_grade - 1]
            each = -np.diff(np.concatenate([np.ones((len(x), 1)), tails, np.zeros((len(x), 1))], axis=1), axis=1)
            cols = [tails.sum(axis=1), p, each.argmax(axis=1).astype(np.int32), p >= spec.keep_p]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], ["doc_id", "expected_grade", "p_tail", "grade", "selected"])

    src = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, expected_grade double, p_tail double, grade int, selected boolean")


def selected_documents(docs: DataFrame, model: Ordinal, spec: QualitySpec = QualitySpec(), *, text: str = "text") -> DataFrame:
    """The rows of `docs` that the model selects, with all their columns, whatever their names.

    Null, empty and very long texts are judged as `score` does; repeated rows stay or go together; an empty table gives none.
    """
    at = docs.columns.index(text)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = linear(b.column(at).to_pylist(), model, spec)
        return b.filter(pa.array(model.tails(x)[:, spec.keep_grade - 1] >= spec.keep_p))

    return rows_in_arrow(docs, run)
