"""Best-fit packing of documents into bins, with conflicts between sources and between duplicates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, named, word_count


@dataclass(frozen=True)
class PackSpec:
    """capacity: words in a bin. part_rows: pieces that are packed together, about; parts are packed independently."""

    capacity: int = 2048
    part_rows: int = 4096
    text: str = "text"
    source: str = "source"
    doc_id: str = "doc_id"


def _bits(names: pd.Series, least: int) -> tuple[np.ndarray, int]:
    """Each name's bit, -1 for null and for names of fewer than `least` rows; and the number of bits."""
    code, found = pd.factorize(names)
    n = np.bincount(code[code >= 0], minlength=len(found))
    bit = np.full(len(found), -1)
    bit[n >= least] = np.arange((n >= least).sum())
    return (np.where(code >= 0, bit[code], -1) if len(found) else np.full(len(code), -1)), int((n >= least).sum())


def best_fit(size: np.ndarray, source: np.ndarray, n_sources: int, cluster: np.ndarray, n_clusters: int, capacity: int) -> np.ndarray:
    """Each item's bin. Items come in the order given. Bins stand in the order of what is left in them (then of their number);
    the search starts at the first bin with room and goes on until one has neither the item's source nor its cluster, which is the
    tightest compatible bin. -1 as source or cluster conflicts with nothing."""
    n = len(size)
    out = np.zeros(n, np.int64)
    left, bins, count = np.empty(n, np.int64), np.empty(n, np.int64), 0  # open bins, by what is left
    has = {k: np.zeros((max(1, -(-m // 64)), n), np.uint64) for k, m in (("s", n_sources), ("c", n_clusters))}
    opened = 0
    for i in range(n):
        need = size[i]
        marks = [(has[k][b >> 6], np.uint64(1 << (b & 63))) for k, b in (("s", int(source[i])), ("c", int(cluster[i]))) if b >= 0]
        at = int(np.searchsorted(left[:count], need, "left"))
        step, place = 16, -1
        while at < count:
            some = bins[at : min(at + step, count)]
            free = np.ones(len(some), bool)
            for words, bit in marks:
                free &= words[some] & bit == 0
            if free.any():
                place = at + int(free.argmax())
                break
            at, step = at + len(some), step * 4
        if place < 0:
            b, rest, place = opened, capacity - need, count
            opened += 1
            count += 1
        else:
            b, rest = int(bins[place]), int(left[place]) - need
        out[i] = b
        for words, bit in marks:
            words[b] |= bit
        if rest == 0:  # full bins leave the order
            left[place : count - 1] = left[place + 1 : count]
            bins[place : count - 1] = bins[place + 1 : count]
            count -= 1
            continue
        to = int(np.searchsorted(left[:place], rest, "left"))
        while to < place and left[to] == rest and bins[to] < b:
            to += 1
        left[to + 1 : place + 1] = left[to:place].copy()
        bins[to + 1 : place + 1] = bins[to:place].copy()
        left[to], bins[to] = rest, b
    return out


def pieces(docs: DataFrame, spec: PackSpec) -> DataFrame:
    """doc_id, source, cluster (texts of the same words up to the case of letters; null for null), place, piece, start, size: whole documents; those over
    the capacity in as many full pieces as they have, and the rest. place tells rows apart that are alike in all."""
    text = named(spec.text)
    words = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    cluster = F.when(text.isNotNull(), F.xxhash64(words))
    place = F.shiftright(F.monotonically_increasing_id(), 8)
    slim = docs.select(named(spec.doc_id).cast("long").alias("doc_id"), named(spec.source).cast("string").alias("source"), cluster.alias("cluster"), place.alias("place"), word_count(text).alias("__n"))
    last = F.greatest(F.ceil(F.col("__n") / spec.capacity), F.lit(1)) - 1
    cut = slim.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    start = F.col("piece") * spec.capacity
    return cut.select("doc_id", "source", "cluster", "place", "piece", start.alias("start"), F.least(F.col("__n") - start, F.lit(spec.capacity)).alias("size"))


def pack(docs: DataFrame, spec: PackSpec = PackSpec()) -> DataFrame:
    """doc_id, piece, start, size (words), bin for every piece of every document.

    No bin is over the capacity, nor holds two pieces of one source or of one duplicate cluster. Pieces are dealt by hash into parts of about part_rows, and
    packed part by part, largest first (ties: by doc_id, then piece); pieces in different parts never share a bin, so conflicts hold overall. A hot source
    or cluster, and copies of one row, are spread over all parts, as the deal also goes by where in the table a row stands. Null sources and clusters conflict with nothing. Documents without words (and null texts) are one piece of size 0
    with a null bin. Ids may be null or repeated; equal rows are pieces of their own. An empty table gives no rows; other columns are not read.
    """
    cut = materialize(pieces(docs, spec))
    full = cut.where("size > 0")
    parts = max(1, -(-full.count() // spec.part_rows))
    part = F.pmod(F.xxhash64("doc_id", "cluster", "piece", "place"), F.lit(parts))
    schema = "doc_id long, piece long, start long, size long, bin long"
    capacity = spec.capacity

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        source, n_sources = _bits(rows["source"], 1)
        cluster, n_clusters = _bits(rows["cluster"], 2)
        rows["bin"] = best_fit(rows["size"].to_numpy(), source, n_sources, cluster, n_clusters, capacity) + (key[0] << 32)
        return rows[["doc_id", "piece", "start", "size", "bin"]]

    packed = full.withColumn("__part", part).groupBy("__part").applyInPandas(run, schema)
    rest = cut.where("size = 0").select("doc_id", "piece", "start", "size", F.lit(None).cast("long").alias("bin"))
    return packed.unionAll(rest)
