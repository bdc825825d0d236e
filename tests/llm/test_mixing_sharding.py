import random
import re
import zlib

import pytest
from compare import of_frame, of_sql
from helpers import awkward, nothing

from folioq.llm import common, matroska, mixing, packing, pii, quality, queries, secrets, sharding, simhash
from folioq.llm.mixing import MixSpec

SF = "/root/testdata/sf0.001"


def test_mix_equals_sql(spark, duck):
    assert of_frame(queries.op1_mix_sources(spark, SF)) == of_sql(duck, queries.ORACLE_SQL["op1_mix_sources"])


def targets(sizes, weights, share, cap):
    """The rule as it is told: share out, stop at the cap, share out the excess again."""
    got, budget, free = {}, share * sum(sizes.values()), list(sizes)
    while free:
        level = budget / sum(weights[s] for s in free)
        full = [s for s in free if level * weights[s] > cap * sizes[s]]
        if not full:
            return got | {s: level * weights[s] for s in free}
        for s in full:
            got[s] = float(cap * sizes[s])
            budget -= got[s]
            free.remove(s)
    return got


def test_mix_awkward(spark):
    df = awkward(spark)
    rows = mixing.mix(df).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    src = df.collect()
    assert sorted((r.size for r in rows)) == sorted(words(r.text) for r in src)
    sizes = {}
    for r in src:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5, 2)
    assert {round(r.target, 6) for r in rows} == {round(x, 6) for x in want.values()}
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    largest = max(r.size for r in rows)
    for s in names:
        mine = [r for r in rows if abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s]]
        assert abs(sum(r.taken for r in mine) - want[s]) <= 5 * largest / 2
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and sum(words(r.text) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(nothing(spark)).count() == 0 and mixing.mixed_documents(nothing(spark)).count() == 0


@pytest.mark.parametrize("spec", [MixSpec(share=2.0), MixSpec(share=0.3, weights=(1,)), MixSpec(share=1.0, weights=(1, 100), cap=3)])
def test_mix_budget(spark, spec):
    df = spark.range(4000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 9 as int)) text", "concat('s', id % 5) source")
    rows = mixing.mix(df, spec).collect()
    total = sum(r.size for r in rows)
    per = {r.target: 0 for r in rows}
    for r in rows:
        assert r.taken <= spec.cap * r.size
    assert abs(sum(r.taken for r in rows) - min(spec.share, spec.cap) * total) <= 5 * 9
    assert per


def test_hot_boundary_is_refined(spark):
    """All hashes of a source in few buckets: thresholds come from deeper levels."""
    slim = spark.range(500).selectExpr("cast(null as string) source", "3L size", "(1L << 59) + id * 5 h")
    cuts = mixing.mix_thresholds(slim, MixSpec(share=0.5)).first()
    assert (cuts.repeats, cuts.source_size, cuts.threshold) == (0, 1500, (1 << 59) + 249 * 5 + 1)


def by_hand(sizes, n):
    """Longest first, each to the least loaded: how many of each size each shard takes, and the loads."""
    loads, took = [0] * n, {}
    for size in sorted(sizes, reverse=True):
        s = loads.index(min(loads))
        loads[s] += size
        took[size, s] = took.get((size, s), 0) + 1
    return took, loads


@pytest.mark.parametrize("n", [1, 3, 7, 40])
def test_lpt(n):
    rng = random.Random(n)
    for most, kinds in ((30, 20), (2000, 4), (700, 60), (5000, 1)):
        sizes = [(rng.randrange(1, 500), rng.randrange(1, most)) for _ in range(kinds)]
        sizes = list(dict(sizes).items())
        got = {}
        for size, before, shards, upto in sharding.schedule(sizes, n):
            assert before == sum(c for s, c in sizes if s > size)
            for s, a, z in zip(shards, [0, *upto], upto):
                got[size, s] = z - a
        assert got == by_hand([s for s, c in sizes for _ in range(c)], n)[0]


def check_shards(rows, src, n):
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in src)
    slots = {}
    for r in rows:
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_awkward(spark):
    df = awkward(spark)
    rows, src = sharding.shard(df, 5).collect(), df.collect()
    check_shards(rows, src, 5)
    of = {}
    for r in rows:
        if r.text_crc32:
            assert of.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    assert sharding.shard(nothing(spark)).count() == 0


@pytest.mark.parametrize("n", [300, 40_000])
def test_shards_are_the_heap_schedule(spark, monkeypatch, n):
    """At any size the loads are those of the schedule made by hand, group by group."""
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 10)
    df = spark.range(n).selectExpr("id doc_id", "concat(repeat('x', cast(1 + (id * id) % 977 as int)), id % 20011) text").unionAll(spark.range(n // 3).selectExpr("cast(null as long)", "'hot'"))
    groups = {}
    for r in (src := df.collect()):
        groups[r.text] = groups.get(r.text, 0) + len(r.text) + 16
    rows = sharding.shard(df, 7).collect()
    check_shards(rows, src, 7)
    got, of = [0] * 7, {}
    for r in rows:
        got[r.shard] += r.size
        assert of.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    assert got == by_hand(groups.values(), 7)[1]


def test_copies_of_one_row_are_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 1000)
    df = spark.range(200_000).selectExpr("cast(null as long) doc_id", "'same' text")
    slots = [r.slot for r in sharding.shard(df, 3).collect()]
    assert sorted(slots) == list(range(200_000))


RESERVED = ("__s", "__threshold", "__repeats", "__copies", "__copy", "__k", "__z", "__rk", "__rz", "__hash", "__row")


def with_odd_columns(spark):
    """Names that operators use themselves, a dot, a blank and a backtick, and ids of another whole type."""
    odd = [*RESERVED, "a.b", "c d", "e`f"]
    rows = [(i % 25, f"w{i % 10} one two three four five six seven", f"s{i % 3}", *range(i, i + len(odd))) for i in range(40)]
    names = ["doc_id int", "text string", "source string", *(f"`{c.replace('`', '``')}` long" for c in odd)]
    return spark.createDataFrame(rows, ", ".join(names))


def test_odd_columns_stay_what_they_are(spark):
    df = with_odd_columns(spark)
    before = {tuple(r) for r in df.collect()}
    model = quality.train(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id int, grade int"))
    for out in (mixing.mixed_documents(df), simhash.deduplicated(df), pii.masked_documents(df), quality.selected_documents(df, model)):
        rows = [tuple(r) for r in out.collect()]
        assert out.columns == df.columns and set(rows) <= before
    for f in (mixing.mix, sharding.shard, simhash.near_duplicates, simhash.near_groups, pii.pii_spans, secrets.secret_spans, matroska.text_media, lambda d: quality.score(d, model)):
        assert f(df).count() == 40
    assert packing.pack(df).count() == 40


def test_scratch_tables_can_go(spark):
    with common.stage_tables(spark) as written:
        kept = common.materialize(spark.range(5))
        common.materialize(spark.range(7))
        path = written.pop(0)
    assert kept.count() == 5 and len(written) == 1 and path not in written
    with pytest.raises(Exception):
        spark.read.parquet(written[0]).count()
