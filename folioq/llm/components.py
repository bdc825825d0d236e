"""Connected components of an edge table, by alternating star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """`pairs` (u, v) with `m`, the least node at u. Both sides are written tables, so that a node with very many
    neighbours is an ordinary skewed join, which adaptive execution splits."""
    return pairs.join(low, "u")


def _low(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component. `edges` has (u, v), long, in any order.

    Loops and repeated edges are ignored; no edges give no rows. Nodes are compared as signed longs.
    Large-star and small-star steps alternate until the edges no longer change; that takes about as many rounds as the
    logarithm of the longest path, and each round is written to the shared scratch folder.
    """
    flat = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    cur = materialize(flat.distinct())
    seen = _digest(cur)
    while seen[0]:
        both = materialize(cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = _star(both, _low(both)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        low = _low(large)
        small = _star(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v")
        cur = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = _digest(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
