"""Bounded training samples and the linear fits that the classifiers share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named
from .features import Features


@dataclass
class Sample:
    """Training rows: of each, targets (a column for each target) and its features (row, feature, value)."""

    targets: np.ndarray
    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.targets)

    def compact(self) -> tuple[np.ndarray, Sample]:
        """The features that occur, and the sample with those numbered anew. What does not occur would get no weight."""
        names = np.flatnonzero(np.bincount(self.feature))
        place = np.zeros(names[-1] + 1 if len(names) else 0, np.int32)
        place[names] = np.arange(len(names))
        return names, Sample(self.targets, self.row, place[self.feature], self.value)


def sample(docs: DataFrame, labels: DataFrame, targets: list[str], features: Features, most: int, *, text: str, doc_id: str) -> Sample:
    """At most `most` labelled rows of `docs`, those with the least hash of their id; the same rows in every run.

    `labels` has doc_id and `targets`; ids are compared as longs, whatever whole type they have; rows in which any of those is null are left out, and of an id's several labels the least
    of each target counts. Only labels are ordered; the `most` that are picked are broadcast, which bounds that by a parameter. Texts become
    features on the executors.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *targets)
    known = labels.dropna(subset=["doc_id", *targets]).groupBy("doc_id").agg(*[F.min(t).cast("double").alias(t) for t in targets])
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    src = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    rows = src.join(F.broadcast(picked), "doc_id").select("doc_id", "text", F.array(*targets).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, feature, value = features.rows(b.column(1).to_pylist())
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            cut = lambda x, kind: pa.array([x[i:j].astype(kind).tobytes() for i, j in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), cut(feature, "<i4"), cut(value, "<f4")], ["doc_id", "y", "f", "v"])

    made = rows.mapInArrow(run, "doc_id long, y array<double>, f binary, v binary")
    got = made.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("f")).limit(most).toArrow()  # at most `most` rows
    flat = lambda k, kind: np.frombuffer(b"".join(x.as_py() for x in got.column(k)), kind)
    sizes = [len(x.as_buffer()) // 4 for x in got.column("f")]
    y = np.array(got.column("y").to_pylist(), float).reshape(len(got), len(targets))
    return Sample(y, np.repeat(np.arange(len(got), dtype=np.int32), sizes), flat("f", "<i4"), flat("v", "<f4"))


def adam(loss_slope: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam with a falling rate: the same result in every run."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = loss_slope(x)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return x


def logistic(s: Sample, d: int, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, scale: np.ndarray, l2: float, rounds: int = 60, close: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of `d` features, and of the columns of `extra` and a constant, that minimise
    sum(weight * log loss) + l2 / 2 * (square of all weights), the features' values being multiplied by `scale`.

    Dual coordinate ascent: row by row the one dual variable is set to its best value. The problem is strictly convex, so the result is
    the optimum up to `close` (the greatest change of a dual variable, as part of its range, in the last round).
    """
    n = len(s)
    w, u, dual = np.zeros(d), np.zeros(extra.shape[1] + 1), np.zeros(n)
    more = np.column_stack([extra, np.ones(n)])
    value = s.value * scale[s.feature]
    squares = np.bincount(s.row, value * value, n) + (more * more).sum(axis=1)
    at = np.searchsorted(s.row, np.arange(n + 1)).tolist()
    sign = np.where(y > 0, 1.0, -1.0).tolist()
    order, rng = np.flatnonzero(weight > 0), np.random.default_rng(11)
    for _ in range(rounds):
        rng.shuffle(order)
        worst = 0.0
        for i in order.tolist():
            f, v, e = s.feature[at[i] : at[i + 1]], value[at[i] : at[i + 1]], more[i]
            most, old, q = float(weight[i]), float(dual[i]), float(squares[i]) / l2
            margin = sign[i] * float(w[f] @ v + u @ e)
            lo, hi = margin - q * old, margin + q * (most - old)
            m = min(max(margin, lo), hi)
            for _ in range(60):  # Newton's steps for the margin after the move, kept within its bounds
                p = 1 / (1 + math.exp(min(m, 700.0)))
                off = m - margin - q * (most * p - old)
                if abs(off) <= 1e-9 * (1 + abs(m)):
                    break
                lo, hi = (lo, m) if off > 0 else (m, hi)
                m -= off / (1 + q * most * p * (1 - p))
                if not lo < m < hi:
                    m = (lo + hi) / 2
            new = most / (1 + math.exp(min(m, 700.0)))
            step = sign[i] * (new - old) / l2
            w[f] += step * v
            u += step * e
            dual[i] = new
            worst = max(worst, abs(new - old) / most)
        if worst < close:
            break
    return w * scale, u


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
