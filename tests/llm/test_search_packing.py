import random

import numpy as np
import pytest
from helpers import awkward, nothing
from pyspark.sql import functions as F

from folioq.llm import ann, packing, queries
from folioq.llm.ann import AnnSpec

SF = "/root/testdata/sf0.1"


def nearest(ids, x, q, k):
    s = x @ x[q]
    s[ids == ids[q]] = -np.inf
    at = np.lexsort((ids, -s))[:k]
    return [int(ids[i]) for i in at if s[i] > -np.inf], s


def test_recall(spark):
    got = queries.op8_additive_quantisation(spark, SF).toPandas()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    hits = 0
    queries_ = np.flatnonzero(ids % 20 == 0)
    by = dict(list(got.groupby("query_id")))
    assert set(by) == set(ids[queries_])
    for q in queries_:
        want, s = nearest(ids, x, q, 20)
        g = by[ids[q]].sort_values("rank")
        place = {int(i): p for p, i in enumerate(ids)}
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, [s[place[i]] for i in g.vec_id], rtol=1e-12)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
        hits += len(set(want) & set(g.vec_id))
    assert hits >= 0.95 * 20 * len(queries_)


def test_blocks_and_ties(spark):
    """Many blocks of rows and of queries, and a vector that a third of all rows share."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    spec = AnnSpec(block_rows=200, query_rows=10, rerank=60)
    index, books = ann.build_index(df, spec)
    got = ann.search(index, books, F.col("vec_id") % 20 == 0, spec).toPandas()
    ids = np.arange(900)
    hits = 0
    for q in range(0, 900, 20):
        g = got[got.query_id == q].sort_values("rank")
        want = nearest(ids, x, q, 20)[0]
        hits += len(set(want) & set(g.vec_id))
        if q % 3 == 0:
            same = [i for i in range(0, 900, 3) if i != q][:20]
            assert list(g.vec_id) == same or set(want) != set(same)
    assert hits >= 0.9 * 20 * 45


def test_codes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 24)) * rng.uniform(0.1, 9, size=(400, 1))
    spec = AnnSpec(books=4, words=32)
    books = ann.fit(x, spec)
    errors = []
    for beam in (1, 8):
        codes, norms = ann.encode(x, books, AnnSpec(books=4, words=32, beam=beam))
        made = books.books[np.arange(4)[None], codes].sum(axis=1) * norms[:, None]
        errors.append(((made - x) ** 2).sum() / (x**2).sum())
    assert errors[1] <= errors[0] < 0.6


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (40, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (1, [0.5, 0.5]), (60, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, score string")
    index, books = ann.build_index(df)
    got = [tuple(r) for r in ann.search(index, books, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 1, 0.5)]
    index, books = ann.build_index(df.limit(0))
    assert ann.search(index, books, F.lit(True)).count() == 0


@pytest.mark.parametrize("size", [1e-200, 1e200, 5e-324, 1e308, 1e-300])
def test_vectors_of_any_size(spark, size):
    """One vector that is far longer or shorter than all others changes nothing for these, and takes part."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 8))
    x[7] = np.sign(x[7]) * size
    x[40] = np.abs(x[40]) * (size if size < 1 else 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {q: list(g.sort_values("rank").vec_id) for q, g in ann.search(*ann.build_index(df), F.col("vec_id") % 20 == 0).toPandas().groupby("query_id")}
    assert set(got) == set(range(0, 3000, 20)) and all(len(g) == 20 for g in got.values())
    hits = 0
    for q, g in got.items():
        with np.errstate(over="ignore"):
            s = np.array([(v * x[q]).sum() for v in x])
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        hits += len(set(want) & set(g))
        assert g[0] == want[0] or q == 40
    assert hits >= 0.99 * 20 * len(got)


def test_recall_by_depth():
    """What the codes alone recall, and what they leave to the exact scores: one block, few or many of it reranked."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(40, 64))
    x = (centre[rng.integers(0, 40, 6000)] + 0.6 * rng.normal(size=(6000, 64))).astype(np.float32).astype(float)
    spec = AnnSpec()
    books = ann.fit(x[:4096], spec)
    codes, norms = ann.encode(x, books, spec)
    ids, q = np.arange(6000), np.arange(0, 6000, 100)
    recall = {}
    for depth in (20, 100, 300, 1000):
        got = ann.search_block(ids, x, codes, norms, q, x[q], books, AnnSpec(rerank=depth))
        recall[depth] = np.mean([len(set(nearest(ids, x, i, 20)[0]) & set(v)) / 20 for i, (_, v, _) in zip(q, got)])
    assert recall[20] > 0.5 and recall[100] > 0.9 and recall[300] > 0.97 and recall[1000] > 0.99, recall


def brute_fit(items, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [b for b in range(len(bins)) if bins[b][0] >= size and source not in bins[b][1] and cluster not in bins[b][2]]
        b = min(fits, key=lambda b: (bins[b][0], b)) if fits else len(bins)
        if b == len(bins):
            bins.append([capacity, set(), set()])
        bins[b][0] -= size
        bins[b][1] |= {source} - {-1}
        bins[b][2] |= {cluster} - {-1}
        out.append(b)
    return out


@pytest.mark.parametrize("seed, sources, clusters", [(0, 3, 5), (1, 200, 100), (2, 70, 1), (3, 1, 1)])
def test_best_fit_is_brute_force(seed, sources, clusters):
    rng = random.Random(seed)
    items = sorted(((rng.randrange(1, 101), rng.randrange(-1, sources), rng.randrange(-1, clusters)) for _ in range(400)), reverse=True)
    size, source, cluster = (np.array(x) for x in zip(*items))
    assert list(packing.best_fit(size, source, sources, cluster, clusters, 100)) == brute_fit(items, 100)


def held(rows, docs, capacity):
    """Every word of every document is in one piece, and no bin breaks a rule."""
    words = {}
    for r in docs.collect():
        words.setdefault(r.doc_id, []).append((len((r.text or "").split()), r.source, (r.text or "").lower() if r.text is not None else None))
    total, bins = {}, {}
    for r in rows:
        assert 0 <= r.size <= capacity and r.start == r.piece * capacity and (r.bin is None) == (r.size == 0)
        total[r.doc_id] = total.get(r.doc_id, 0) + r.size
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    assert total == {k: sum(n for n, _, _ in v) for k, v in words.items()}
    for inside in bins.values():
        assert sum(r.size for r in inside) <= capacity
        known = [words[r.doc_id][0] for r in inside if len(words[r.doc_id]) == 1]
        for i in (1, 2):
            marks = [k[i] for k in known if k[i] is not None]
            assert len(marks) == len(set(marks))


def test_packing(spark):
    df = awkward(spark)
    for spec in (packing.PackSpec(capacity=100), packing.PackSpec(capacity=100, part_rows=7)):
        held(packing.pack(df, spec).collect(), df, 100)
    assert packing.pack(nothing(spark)).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held(packing.pack(docs).collect(), docs, 2048)


def test_dealt_query_is_brute_force(spark):
    """Each part of the whole query, packed again by looking at every bin."""
    docs = awkward(spark).unionAll(awkward(spark, 90, 5).withColumn("doc_id", F.col("doc_id") + 1000)).where("doc_id IS NOT NULL")
    spec = packing.PackSpec(capacity=100, part_rows=20)
    rows = packing.pack(docs, spec).where("bin IS NOT NULL").collect()
    about = {}
    for r in docs.collect():
        about.setdefault(r.doc_id, set()).add((r.source, " ".join((r.text or "").lower().split())))
    parts = {}
    for r in rows:
        parts.setdefault(r.bin >> 32, []).append(r)
    assert len(parts) > 5
    for part in parts.values():
        part.sort(key=lambda r: (-r.size, r.doc_id is None, r.doc_id or 0, r.piece))
        texts = [next(iter(about[r.doc_id])) for r in part]
        again = [c for _, c in texts]
        items = [(r.size, s if s is not None else -1, c if again.count(c) > 1 else -1) for r, (s, c) in zip(part, texts)]
        assert [r.bin & 0xFFFFFFFF for r in part] == brute_fit(items, 100)


def test_clusters_are_texts_of_the_same_words(spark):
    df = spark.createDataFrame([(1, "Some  words", "a"), (2, "some\twords ", "b"), (3, "some word s", "c"), (4, None, "d")], "doc_id long, text string, source string")
    got = {r.doc_id: r.cluster for r in packing.pieces(df, packing.PackSpec()).collect()}
    assert got[1] == got[2] != got[3] and got[4] is None


def test_copies_of_one_row_take_linear_time(spark):
    """Each needs a bin of its own; they are dealt over all parts, so no task has them all."""
    df = spark.range(100_000, numPartitions=8).selectExpr("cast(null as long) doc_id", "'a few words' text", "'s' source")
    got = packing.pack(df).selectExpr("bin >> 32 part", "bin").groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("bin").alias("bins")).collect()
    assert sum(r.n for r in got) == 100_000 and all(r.n == r.bins for r in got) and max(r.n for r in got) < 4 * packing.PackSpec().part_rows
