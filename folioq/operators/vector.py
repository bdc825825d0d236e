"""Exact vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BindFault
from ..functions.operators import _cosine, dot

METRICS = ("cosine", "euclidean", "dot")


def distance(vector: Column, target: list[float], metric: str) -> Column:
    """The metric's distance; for dot the similarity, of which more is nearer. Null where lengths differ."""
    if metric not in METRICS:
        raise BindFault(f"no metric {metric!r}")
    x = F.transform(vector, lambda v: v.cast("float").cast("double"))
    y = F.array(*[F.lit(float(v)) for v in target])
    if metric == "cosine":
        return 1 - _cosine(x, y)
    here = F.size(x) == len(target)
    if metric == "dot":
        return F.when(here, dot(x, y))
    return F.when(here, F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)))


def top_k_near(df: DataFrame, vector: str, target: list[float], k: int, metric: str = "cosine", key: str = "_id") -> DataFrame:
    """The k nearest rows with `distance`, nearest first, ties by key: each task keeps its k best, and only those meet."""
    near = df.withColumn("distance", distance(F.col(vector), target, metric)).where("distance IS NOT NULL")
    return near.orderBy(F.desc("distance") if metric == "dot" else F.asc("distance"), key).limit(k)


def find_near(df: DataFrame, vector: str, target: list[float], most: float, metric: str = "cosine") -> DataFrame:
    """Rows within `most` of the target; for dot, of at least that similarity."""
    near = df.withColumn("distance", distance(F.col(vector), target, metric))
    return near.where(F.col("distance") >= most if metric == "dot" else F.col("distance") <= most)
