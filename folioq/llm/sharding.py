"""Sharding by longest-processing-time scheduling of groups that stay together."""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import broadcast_if_small, materialize, named, numbered

#: Rows that are numbered together at most, about, and the least number of such chunks a shard.
CHUNK_ROWS, CHUNKS = 200_000, 16
#: A group with at least 1/HOT of all rows is broadcast, so there are at most HOT of those; rows of the others meet their group by a shuffle.
HOT = 2048
PER_GROUP = 16


class Loads:
    """The shards' loads, and who takes the next group: the least loaded one (ties: the lower number), by a heap."""

    def __init__(self, shards: int) -> None:
        self.heap = [(0, s) for s in range(shards)]

    def deal(self, size: int, count: int) -> list[tuple[int, int]]:
        """`count` groups of one size, one after the other to the least-loaded shard: (shard, how many), by shard.

        Many at once need no step for each. Shard i's turns are at the loads L_i, L_i + size, ...; the `count` least of all
        these turns are taken, so the highest level up to which all are taken tells the rest.
        """
        took = dict.fromkeys(range(len(self.heap)), 0)
        if count > 8 * len(self.heap):
            loads = {s: load for load, s in self.heap}
            turns = lambda level: sum(max(0, -((load - level) // size)) for load in loads.values())
            low, high = min(loads.values()), max(loads.values()) + size * count
            while high - low > 1:  # turns(low) <= count < turns(high)
                level = (low + high) // 2
                low, high = (level, high) if turns(level) <= count else (low, level)
            for s, load in loads.items():
                took[s] = max(0, -((load - low) // size))
            count -= sum(took.values())
            self.heap = [(load + took[s] * size, s) for s, load in loads.items()]
            heapq.heapify(self.heap)
        for _ in range(count):
            load, s = self.heap[0]
            heapq.heapreplace(self.heap, (load + size, s))
            took[s] += 1
        return [(s, n) for s, n in took.items() if n]


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, list[int], list[int]]]:
    """The longest-processing-time schedule of (size, number of groups): for each size, largest first, (size, groups before it, shards,
    up to which of its groups each shard takes)."""
    loads, before, out = Loads(shards), 0, []
    for size, count in sorted(sizes, reverse=True):
        dealt = loads.deal(size, count)
        out.append((size, before, [s for s, _ in dealt], list(accumulate(n for _, n in dealt))))
        before += count
    return out


def shard(docs: DataFrame, shards: int = 40, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Rows with equal texts form a group and stay together. Groups, largest first, go to the shard with the least bytes. Groups of
    equal size are interchangeable, so the driver needs no more than how many there are of each size: sizes that differ add up to
    all bytes at most, so these are sqrt(2 * bytes) at most (14 million for 100 TB), however many groups there are. Which of a
    size's groups go where is told by their number in the order of their hash. Slots are numbered in chunks of a shard by a hash of the row
    and of where it stands in the table, so no task holds a whole shard, or all rows of one id.

    A null text has size 16, CRC 0, and groups with other null texts; an empty text is another group of that kind. Ids
    may be null or repeated; rows alike in all are numbered in any order, which gives the same rows. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    t = named(text)
    slim = docs.select(
        named(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + PER_GROUP).alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(t, F.lit("")), t.isNull()).alias("__group"),
        F.shiftright(F.monotonically_increasing_id(), 12).alias("__place"),
    )
    slim = materialize(slim)
    groups = materialize(slim.groupBy("__group").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows")))
    sizes = groups.groupBy("__bytes").count().toArrow()  # at most sqrt(2 * bytes) rows
    plan = schedule(list(zip(*(c.to_pylist() for c in sizes.columns))), shards)
    rows = slim.count()
    kinds = "__bytes long, __before long, __shards array<int>, __upto array<long>"
    plan = broadcast_if_small(materialize(spark.createDataFrame(plan, kinds)))
    ranked = numbered(groups, [F.desc("__bytes"), F.col("__group")], "__at").join(plan, "__bytes")
    place = F.size(F.filter("__upto", lambda n: n <= F.col("__at") - F.col("__before")))
    placed = materialize(ranked.select("__group", F.get("__shards", place).alias("shard"), (F.col("__rows") * HOT >= rows).alias("__hot")))

    hot = F.broadcast(placed.where("__hot").drop("__hot"))  # at most HOT rows
    rest = broadcast_if_small(placed.where("NOT __hot").drop("__hot"))
    told = slim.join(hot, "__group", "left")
    told = told.where("shard IS NOT NULL").unionByName(told.where("shard IS NULL").drop("shard").join(rest, "__group"))

    chunks = max(CHUNKS, -(-rows // (CHUNK_ROWS * shards)))
    chunk = F.pmod(F.xxhash64("doc_id", "__group", "__place"), F.lit(chunks)).cast("int")
    told = materialize(told.select("doc_id", "size", "text_crc32", "shard", chunk.alias("__chunk"), "__group"))
    counts = told.groupBy("shard", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy("shard").orderBy("__chunk")) - F.col("__n")
    counts = counts.select("shard", "__chunk", before.alias("__before"))
    local = F.row_number().over(W.partitionBy("shard", "__chunk").orderBy("doc_id", "__group")) - 1
    out = told.withColumn("__local", local).join(broadcast_if_small(counts), ["shard", "__chunk"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__local") + F.col("__before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
