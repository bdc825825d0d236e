import random
from collections import Counter

import numpy as np
import xxhash
from helpers import awkward, nothing
from pyspark.sql import functions as F

from folioq.llm import simhash as S
from folioq.llm.common import pair_tasks
from folioq.llm.components import components


def fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def least_reachable(fps, ids, most=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                parent[find(i)] = find(j)
    best = {}
    for i in range(len(fps)):
        r = find(i)
        if ids[i] is not None:
            best[r] = min(best.get(r, ids[i]), ids[i])
    return [best.get(find(i)) for i in range(len(fps))]


def held_against_brute_force(df):
    src = [(r.doc_id, r.text) for r in df.collect()]
    fps = [fingerprint(t) for _, t in src]
    want = sorted(zip([i for i, _ in src], [f"{f:016x}" for f in fps], least_reachable(fps, [i for i, _ in src])), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()), key=repr) == want


def test_near_duplicates(spark):
    held_against_brute_force(awkward(spark))
    rng = random.Random(1)
    base = [[f"t{rng.randrange(5000)}" for _ in range(150)] for _ in range(25)]
    texts = []
    for words in base:
        for _ in range(4):
            mine = list(words)
            for _ in range(rng.randrange(3)):
                mine[rng.randrange(150)] = "changed"
            texts.append(" ".join(mine))
    held_against_brute_force(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert S.near_duplicates(nothing(spark)).count() == 0


def test_hash_is_sparks(spark):
    words = [b"a", b"b", "é".encode(), b"d", b"e"]
    want = spark.sql("select xxhash64('a b é d') x, xxhash64('b é d e') y").first()
    assert [S.signed(int(h)) for h in S.shingle_hashes(words, 4)] == [want.x, want.y]


def test_ring_finds_every_link(monkeypatch):
    rng = np.random.default_rng(0)
    f = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    f[:1500] = f[rng.integers(1500, 1600, 1500)]
    for i in range(1500):
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            f[i] ^= np.uint64(1) << np.uint64(b)
    f = np.unique(f)
    n = len(f)
    seg = lambda j: (f >> np.uint64(S.OFFSETS[j])) & np.uint64((1 << S.WIDTHS[j]) - 1)
    keys = np.concatenate([(np.uint64(i << 26) + (seg(i) << np.uint64(13)) + seg((i + 1) % 5)).astype(np.int64) for i in range(5)])
    at = np.argsort(keys, kind="stable")
    node = np.tile(np.arange(n), 5)[at]
    want, pairs = np.arange(n), [(i, j) for i in range(n) for j in (np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4) + i + 1)]
    S._merge(want, *(np.array(x) for x in zip(*pairs)))
    for limit in (S.PAIRS, 40):
        monkeypatch.setattr(S, "PAIRS", limit)
        label = S.ring_links(keys[at], f[node], np.zeros((len(keys), 0), np.uint64), 0)
        got = np.arange(n)
        S._merge(got, node, node[label])
        assert (got == want).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(-5, 300), (7, 7)]
    edges += [(500, 501 + i) for i in range(200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    near = {n: {n} for n in nodes}
    for _ in nodes:
        for u, v in edges:
            if u != v:
                near[u] = near[v] = near[u] | near[v]
    assert got == {n: min(near[n]) for n in nodes}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_deduplicated(spark):
    rng = random.Random(4)
    rows, near, clean = [], [], []
    for g in range(60):
        words = [f"token{rng.randrange(3000)}" for _ in range(rng.choice([60, 200, 600]))]
        rows.append((10 * g, " ".join(words)))
        for c in range(1, 4):
            mine = list(words)
            for _ in range(max(1, len(words) // 150) * (c - 1)):
                mine[rng.randrange(len(mine))] = f"edit{rng.randrange(10**6)}"
            rows.append((10 * g + c, " ".join(mine)))
            if jaccard(rows[-1][1], " ".join(words)) >= 0.85:
                near.append(10 * g + c)
        rows.append((10 * g + 9, " ".join(f"token{rng.randrange(3000)}" for _ in range(80))))
        clean += [10 * g, 10 * g + 9]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in S.deduplicated(df).collect()}
    assert set(clean) <= kept
    assert sum(i in kept for i in near) <= 0.03 * len(near)
    some = awkward(spark)
    out = S.deduplicated(some)
    ids = [r.doc_id for r in out.collect()]
    named = [i for i in ids if i is not None]
    assert out.columns == some.columns and len(set(named)) == len(named)
    orphans = [r.text for r in some.collect() if r.doc_id is None and r.text]
    assert len(orphans) == len(set(orphans)) == len(ids) - len(named)  # without an id, but unlike any other
    twice = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "q r s t u v"), (3, "l m n o p q"), (4, "q r s t u v")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text[0]) for r in S.deduplicated(twice).collect()), key=repr) in ([(3, "l"), (None, "a")], [(3, "q"), (None, "a")])
    assert S.deduplicated(nothing(spark)).count() == 0


def test_every_kind_of_edit_is_found(spark):
    """Near copies with a cut tail, an appended, swapped or foreign passage, down to a similarity of 0.8; and what is less alike stays."""
    rng = random.Random(5)
    some = lambda n: [f"token{rng.randrange(5000)}" for _ in range(n)]
    edits = {
        "cut": lambda w, x: w[: len(w) - x],
        "append": lambda w, x: w + some(x),
        "swap": lambda w, x: w[len(w) // 2 :] + w[: len(w) // 2],
        "foreign": lambda w, x: w[: len(w) // 3] + some(x // 2) + w[len(w) // 3 + x // 2 :],
        "scattered": lambda w, x: [some(1)[0] if rng.random() < x / len(w) / 6 else y for y in w],
    }
    rows, near, clean = [], {}, []
    for i in range(400):
        words, (name, edit) = some(rng.choice([30, 100, 400, 1200])), rng.choice(list(edits.items()))
        other = edit(words, int(len(words) * rng.uniform(0.02, 0.35)))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        (near.setdefault(name, []) if jaccard(rows[-2][1], rows[-1][1]) >= 0.8 else clean).append(2 * i + 1)
    short = [(1000, "one two three four five six seven eight nine"), (1001, "one two three four five six seven eight nine ten"), (1002, "one two"), (1003, "one two"), (1004, "one three")]
    kept = {r.doc_id for r in S.deduplicated(spark.createDataFrame(rows + short, "doc_id long, text string")).collect()}
    assert len(near) == 5 and {k: sum(i in kept for i in v) for k, v in near.items()} == dict.fromkeys(near, 0)
    assert len(clean) > 50 and set(clean) <= kept
    assert kept & {1000, 1001, 1002, 1003, 1004} == {1000, 1002, 1004}


def test_crowds_are_split(spark, monkeypatch):
    """Groups far over the limits of one task: the same links, and no task with a whole group."""
    monkeypatch.setattr(S, "CROWD", 5)
    monkeypatch.setattr(S, "SETS", 3)
    rng = random.Random(9)
    base = [f"t{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(60):
        mine = list(base)
        mine[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(mine))
    df = spark.createDataFrame(list(enumerate(texts + ["quite another text"])), "doc_id long, text string")
    held_against_brute_force(df)
    groups = {r.doc_id: r.component_id for r in S.near_groups(df).collect()}
    assert groups == {**dict.fromkeys(range(60), 0), 60: 60}
    crowd = spark.range(100).selectExpr("id", "id % 2 AS g")
    got = pair_tasks(crowd, F.col("g"), F.col("id"), 10).collect()
    tasks = {}
    for r in got:
        tasks.setdefault((r.g, r.pair), set()).add(r.id)
    assert max(map(len, tasks.values())) < 50
    assert all(any({a, b} <= t for t in tasks.values()) for a in range(100) for b in range(a % 2, a, 2))


def test_alike_is_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        base = rng.sample(range(100), rng.randrange(4, 30))
        sets = [np.unique(np.array(base[: rng.randrange(1, len(base) + 1)] + rng.sample(range(100, 110), rng.randrange(3)))) for _ in range(rng.randrange(1, 12))]
        near = [{i} for i in range(len(sets))]
        for i in range(len(sets)):
            for j in range(i):
                if 10 * len(set(sets[i]) & set(sets[j])) >= 8 * len(set(sets[i]) | set(sets[j])):
                    for k in (both := near[i] | near[j]):
                        near[k] = both
        assert S.alike(sets, 0.8).tolist() == [min(n) for n in near]


def test_heavy_rows_make_more_blocks(spark):
    rows = spark.range(40).select(F.lit(1).alias("g"), "id", F.lit(4.0).alias("w"))
    assert pair_tasks(rows, F.col("g"), F.col("id"), 50).select("pair").distinct().count() == 1
    got = pair_tasks(rows, F.col("g"), F.col("id"), 50, F.col("w")).collect()
    tasks = {p: {r.id for r in got if r.pair == p} for p in {r.pair for r in got}}
    assert len(tasks) == 6 and max(map(len, tasks.values())) < 40  # four blocks, two at a time
    assert all(any({a, b} <= t for t in tasks.values()) for a in range(40) for b in range(a))


def test_long_fingerprint_is_a_majority():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 64, 65, 300, 1000):
        shingles = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        fp = S.long_fingerprint(shingles, S.Sketch())
        assert len(fp) == (64 if n <= 64 else 32)
        lanes = S.mixed(shingles, len(fp))
        for lane in (0, 1, len(fp) - 1):
            hashes = [int(h) for h in lanes[:, lane]]
            assert int(fp[lane]) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert not len(S.long_fingerprint(np.zeros(0, np.uint64), S.Sketch()))


def test_segments_propose_what_brute_force_does(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, (20, 32), dtype=np.uint64)
    fps = base[rng.integers(0, 20, 150)]
    for f in fps:
        for b in rng.choice(2048, rng.integers(0, 700), replace=False):
            f[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    fps[:40, 3] = np.uint64(0x1234_0000_0000_0000)  # a segment that is common to unlike rows
    parts = fps.view(np.uint16)
    want = np.arange(150)
    pairs = [(i, j) for i in range(150) for j in range(i) if np.bitwise_count(fps[i, :3] ^ fps[j, :3]).sum() <= 60 and (parts[i] == parts[j]).any()]
    assert len(pairs) > 100
    S._merge(want, *(np.array(x) for x in zip(*pairs)))
    prints = spark.createDataFrame([(i, [S.signed(int(w)) for w in f]) for i, f in enumerate(fps)], "id long, fp array<long>")
    for limit in (S.BUCKET, 3):
        monkeypatch.setattr(S, "BUCKET", limit)
        got, groups = np.arange(150), {}
        for lo, hi in ((0, 4), (4, 64)):
            for r in S.proposed(prints, S.Sketch(), lo, hi).collect():
                groups.setdefault(r.b, []).append(r.id)
        assert min(map(len, groups.values())) > 1
        for g in groups.values():
            S._merge(got, np.array(g[1:]), np.full(len(g) - 1, g[0]))
        assert (got == want).all()


def test_fingerprints_alone_propose(spark):
    """No pair comes by another way than the fingerprints: where these may not differ in even -1 bits, all rows but copies stay."""
    words = [f"t{i}" for i in range(100)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:95])), (2, " ".join(words)), (3, " ".join(words[:-1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in S.deduplicated(df).collect()} == {0}
    assert {r.doc_id for r in S.deduplicated(df, S.Sketch(most=-1)).collect()} == {0, 1, 3}


def test_small_sets_are_proposed():
    """Six shingles and any five of them: no shingle decides more bits than another."""
    rng = np.random.default_rng(10)
    for _ in range(300):
        six = np.unique(rng.integers(0, 2**63, 6, dtype=np.uint64))
        x, y = S.long_fingerprint(six, S.Sketch()), S.long_fingerprint(six[1:], S.Sketch())
        assert (x.view(np.uint16) == y.view(np.uint16)).any() and np.bitwise_count(x[:3] ^ y[:3]).sum() <= S.Sketch().most


def test_overlapping_groups_are_looked_at_once(spark, monkeypatch):
    """A crowd that meets in many segments: an id is compared in one group, not in one for each segment; and where that group is too large, the links are the same."""
    rng = random.Random(11)
    base = [f"t{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(60):
        mine = list(base)
        for at in rng.sample(range(150), rng.choice([1, 1, 4])):
            mine[at] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(mine))
    want = np.arange(60)
    near = [(i, j) for i in range(60) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    S._merge(want, *(np.array(x) for x in zip(*near)))
    assert len(set(want)) > 5 and np.bincount(want).max() > 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, links = [], S.shingle_links

    def spy(members, sets, sketch):
        seen.append(Counter(r.id for r in members.collect()))
        return links(members, sets, sketch)

    monkeypatch.setattr(S, "shingle_links", spy)
    for whole in (S.WHOLE, 0):
        monkeypatch.setattr(S, "WHOLE", whole)
        seen.clear()
        assert {r.doc_id: r.component_id for r in S.near_groups(df).collect()} == dict(enumerate(want.tolist()))
        assert len(seen) == 2 and (max(max(x.values(), default=0) for x in seen) == 1) == (whole > 0)
