"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import broadcast_if_small, columns_of, materialize, named, numbered, spare, word_count

HASH_BITS = 60
LEVEL_BITS = 10


@dataclass(frozen=True)
class MixSpec:
    """weights repeat over the sources in code point order (null last); share is the mix's size as a part of
    all sizes; cap is how often a source may be repeated at most (and so a document)."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: int = 2
    text: str = "text"
    source: str = "source"
    doc_id: str = "doc_id"


def sized(docs: DataFrame, spec: MixSpec) -> tuple[Column, Column]:
    """Size in words, and a 60-bit hash that depends on the row's id and text only."""
    text = F.coalesce(named(spec.text), F.lit(""))
    seed = F.concat(F.coalesce(named(spec.doc_id).cast("string"), F.lit("")), F.lit("/"), F.md5(text))
    return word_count(named(spec.text)), F.conv(F.substring(F.md5(seed), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, spec: MixSpec) -> DataFrame:
    """`sizes` (source, source_size) with `target`.

    Sources share `share` of all sizes by weight. A target above `cap` times its source's size stops there and
    the excess goes to the others by weight, until none is above. Each round is one aggregate over the sources.
    """
    keys = [F.col("source").isNull(), F.col("source")]
    ranked = numbered(sizes, keys, "__rank")
    weights = F.array(*[F.lit(float(w)) for w in spec.weights])
    src = ranked.withColumn("__w", F.get(weights, (F.col("__rank") % len(spec.weights)).cast("int")))
    src = materialize(src.withColumn("__most", F.col("source_size") * F.lit(spec.cap)))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("__w") * F.lit(level) >= F.col("__most")
        row = src.agg(
            F.coalesce(F.sum(F.when(full, F.col("__most"))), F.lit(0)).alias("used"),
            F.coalesce(F.sum(F.when(~full, F.col("__w"))), F.lit(0.0)).alias("w"),
        ).first()
        new = (spec.share * total - row.used) / row.w if row.w else level or 0.0
        if new == level or not row.w:
            break
        level = new
    level = 0.0 if level is None else level
    target = F.least(F.col("__most").cast("double"), F.col("__w") * F.lit(float(level)))
    return src.withColumn("target", target).drop("__rank", "__w", "__most")


def mix_thresholds(slim: DataFrame, spec: MixSpec) -> DataFrame:
    """One row for each source: source, source_size, target, repeats, threshold.

    A document with hash h is taken `repeats` times, and once more if h < threshold. Thresholds come from
    histograms: tokens by source and hash bucket give the bucket in which the budget ends; only that bucket is
    split further, by the next bits of the hash, until it holds a single hash. The document at the edge is taken if that
    brings the source nearer to its target. `slim` has source, size and h.
    """
    sizes = materialize(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    src = source_targets(sizes, spec)
    s = F.col("source_size")
    repeats = F.when(s > 0, F.floor(F.col("target") / s)).otherwise(0).cast("long")
    src = src.withColumn("repeats", repeats).withColumn("__left", F.col("target") - repeats * s)
    src = materialize(src)
    open_ = src.where("__left > 0").select("source", F.lit(0).cast("long").alias("__prefix"), "__left")
    found = []
    for used in range(0, HASH_BITS, LEVEL_BITS):
        rows = slim.where("size > 0").join(
            broadcast_if_small(open_.withColumnRenamed("source", "__s")),
            F.col("source").eqNullSafe(F.col("__s")) & (F.expr(f"shiftright(h, {HASH_BITS - used})") == F.col("__prefix")),
        )
        bucket = F.expr(f"shiftright(h, {HASH_BITS - used - LEVEL_BITS})").alias("__bucket")
        hist = rows.groupBy("source", bucket).agg(
            F.sum("size").alias("__size"), F.min("h").alias("__lo"), F.max("h").alias("__hi"), F.first("__left").alias("__left")
        )
        upto = F.sum("__size").over(W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0))
        hist = hist.withColumn("__upto", upto)
        edge = hist.where("__upto >= __left AND __upto - __size < __left")
        edge = materialize(edge.withColumn("__left", F.col("__left") - (F.col("__upto") - F.col("__size"))))
        last = F.col("__lo") == F.col("__hi")
        nearer = F.col("__left") * 2 >= F.col("__size")
        found.append(edge.where(last).select("source", (F.col("__lo") + F.when(nearer, 1).otherwise(0)).alias("threshold")))
        open_ = edge.where(~last).select("source", F.col("__bucket").alias("__prefix"), "__left")
        if open_.isEmpty():
            break
    cuts = found[0]
    for more in found[1:]:
        cuts = cuts.unionAll(more)
    cuts = cuts.withColumnRenamed("source", "__s")
    out = src.join(cuts, F.col("source").eqNullSafe(F.col("__s")), "left")
    return materialize(out.select("source", "source_size", "target", "repeats", F.coalesce("threshold", F.lit(0)).cast("long").alias("threshold")))


def _slim(docs: DataFrame, spec: MixSpec) -> DataFrame:
    size, h = sized(docs, spec)
    return docs.select(named(spec.doc_id).alias("doc_id"), named(spec.source).alias("source"), size.alias("size"), h.alias("h"))


def _copies() -> Column:
    return F.col("repeats") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs`.

    Texts are read once; the passes after that read a table of 30 bytes a row. Nulls: a null text has size 0,
    null sources form one source, a null id hashes as empty. Empty texts are rows with taken 0. Rows with equal id and text
    share a hash and are taken together. An empty table gives no rows; other columns are not read, whatever their names.
    """
    slim = materialize(_slim(docs, spec))
    cuts = mix_thresholds(slim, spec).withColumnRenamed("source", "__s")
    out = slim.join(broadcast_if_small(cuts), F.col("source").eqNullSafe(F.col("__s")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mixed_documents(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The mix itself: rows of `docs`, with their columns, whatever their names, as often as the mix takes them.

    Rows of size 0 (null and empty texts) cannot bring a source nearer to a target and follow their hash like any other row. Null sources
    form one source. Rows with equal id and text share a hash and are taken together. An empty table gives no rows.
    """
    s, repeats, threshold, copy = spare(docs, "__s", "__repeats", "__threshold", "__copy")
    cuts = mix_thresholds(materialize(_slim(docs, spec)), spec)
    cuts = broadcast_if_small(cuts.select(F.col("source").alias(s), F.col("repeats").alias(repeats), F.col("threshold").alias(threshold)))
    copies = F.col(repeats) + F.when(sized(docs, spec)[1] < F.col(threshold), 1).otherwise(0)
    out = docs.join(cuts, named(spec.source).eqNullSafe(F.col(s)), "left").where(copies > 0)
    return out.select(*columns_of(docs), F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias(copy)).drop(copy)
