"""Nearest neighbours by additive quantisation: beam-search codes, stored norms, table scoring, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, named


@dataclass(frozen=True)
class AnnSpec:
    """books codebooks of `words` full-dimensional words, fitted on at most sample_rows vectors; beam: partial codes kept while
    encoding. In each block of about block_rows rows, the `rerank` best by table (and all that tie with the last) are scored exactly.
    query_rows bounds the queries that are broadcast together; a task encodes at least encode_rows rows, if there are as many."""

    books: int = 24
    words: int = 256
    sample_rows: int = 8192
    rounds: int = 8
    beam: int = 4
    k: int = 20
    rerank: int = 1000
    block_rows: int = 32_768
    query_rows: int = 8192
    encode_rows: int = 2048


#: Table scores are smaller by this power of two: they keep their order, and none overflows.
SHIFT = 60
MOST = np.finfo(float).max


@dataclass(frozen=True)
class Codebooks:
    books: np.ndarray  # books x words x dims, float32

    @property
    def dims(self) -> int:
        return self.books.shape[2]


def usable(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows that take part: with an id, no null or non-finite component, not zero, and of the most
    common length (of equally common ones the longest)."""
    x = named(vector).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = named(key).isNotNull() & x.isNotNull() & F.forall(x, finite) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(good).select(named(key).cast("long").alias("vec_id"), x.alias("x"))
    most = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("x") == (most.n if most else 0))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over their largest component, and that component: squares and products of what is left neither vanish nor overflow."""
    most = np.abs(x).max(axis=1)
    up = np.where(most < 1e-300, 900, 0)  # what is next to nothing is lifted first, as it has few digits
    return np.ldexp(x, up[:, None]) / np.ldexp(most, up)[:, None], most


def _unit(x: np.ndarray) -> np.ndarray:
    x, _ = scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (np.einsum("ij,ij->i", words, words) / 2 - x @ words.T).argmin(axis=1)


def fit(sample: np.ndarray, spec: AnnSpec) -> Codebooks:
    """Residual codebooks: each is fitted by Lloyd's rounds to what the ones before it leave of the unit vectors."""
    rest = _unit(sample)
    rng = np.random.default_rng(7)
    books = []
    for _ in range(spec.books):
        k = min(spec.words, len(rest))
        words = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(spec.rounds):
            near = _nearest(rest, words)
            n = np.bincount(near, minlength=k)
            total = np.zeros_like(words)
            np.add.at(total, near, rest)
            words[n > 0] = total[n > 0] / n[n > 0, None]
        rest = rest - words[_nearest(rest, words)]
        books.append(np.pad(words, ((0, spec.words - k), (0, 0)), mode="edge"))
    return Codebooks(np.stack(books))


def encode(x: np.ndarray, books: Codebooks, spec: AnnSpec) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x books, uint8) and norms. A beam of partial sums is kept for each vector; the stored norm is the factor that
    brings the sum of code words nearest to the vector, and finite for every finite vector."""
    unit = _unit(x)
    n, d = unit.shape
    rest, codes, cost = unit[:, None, :], np.zeros((n, 1, 0), np.uint8), None
    for words in books.books:
        half = np.einsum("ij,ij->i", words, words)
        b = rest.shape[1]
        gain = half[None, None, :] - 2 * (rest.reshape(-1, d) @ words.T).reshape(n, b, -1)
        total = (gain if cost is None else gain + cost[:, :, None]).reshape(n, -1)
        keep = min(spec.beam, total.shape[1])
        best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
        cost = np.take_along_axis(total, best, 1)
        parent, word = np.divmod(best, len(words))
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - words[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
    codes = codes[np.arange(n), cost.argmin(axis=1)]
    made = books.books[np.arange(len(books.books))[None, :], codes].sum(axis=1)
    made, (part, most) = made.astype(float), scaled(x)
    factor = np.einsum("ij,ij->i", part, made) / np.maximum(np.einsum("ij,ij->i", made, made), 1e-12)
    with np.errstate(over="ignore"):
        return codes, np.clip(factor * most, -MOST, MOST)


def _matrix(column: pa.Array, kind: str = "f8") -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def build_index(vectors: DataFrame, spec: AnnSpec = AnnSpec(), *, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Codebooks | None]:
    """The index (vec_id, x, codes, norm), a written table, and its codebooks. The sample for these is the sample_rows usable
    vectors with the least hash of their id; every usable row is indexed. Encoding takes as many tasks as the cluster has cores, or more."""
    rows = usable(vectors, key=key, vector=vector)
    rows = materialize(rows)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("x")).limit(spec.sample_rows).toArrow()  # at most sample_rows
    if not picked.num_rows:
        return rows.withColumns({"codes": F.lit(None).cast("binary"), "norm": F.lit(None).cast("double")}), None
    books = fit(_matrix(picked.column("x").combine_chunks()), spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                codes, norms = encode(_matrix(part.column(1)), books, spec)
                code = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), code, pa.array(norms)], ["vec_id", "x", "codes", "norm"])

    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-n // spec.block_rows), min(cores, n // spec.encode_rows), 1)
    dealt = rows.repartition(tasks, "vec_id") if tasks > 1 else rows
    return materialize(dealt.mapInArrow(run, "vec_id long, x array<double>, codes binary, norm double")), books


def search_block(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, q_ids: np.ndarray, q: np.ndarray, books: Codebooks, spec: AnnSpec) -> list[tuple[np.ndarray, ...]]:
    """The best k of a block for each query: (query ids, vec_ids, exact scores), ties to the smaller vec_id; scores that are not
    numbers (infinities that cancel) come last."""
    out = []
    m = len(books.books)
    for at in range(0, len(q), 32):
        some = scaled(q[at : at + 32])[0].astype(np.float32)  # a query's length does not change the order
        table = np.einsum("qd,mkd->mqk", some, books.books)
        sums = np.zeros((len(some), len(ids)), np.float32)
        for j in range(m):
            sums += np.take(table[j], codes[:, j], axis=1)
        near = sums * np.ldexp(norms, -SHIFT)
        near[q_ids[at : at + 32, None] == ids[None, :]] = -np.inf
        depth = min(spec.rerank, len(ids))
        least = np.partition(near, len(ids) - depth, axis=1)[:, len(ids) - depth]
        for i in range(len(some)):
            c = np.flatnonzero((near[i] >= least[i]) & (near[i] > -np.inf))
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (x[c] * q[at + i]).sum(axis=1)  # row by row, so that equal vectors have equal scores
            best = np.lexsort((ids[c], -exact))[: spec.k]
            out.append((np.full(len(best), q_ids[at + i]), ids[c][best], exact[best]))
    return out


def search(index: DataFrame, books: Codebooks | None, queries: Column, spec: AnnSpec = AnnSpec()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of the index that `queries` picks, its k largest inner products.

    Queries go out in blocks of at most query_rows, broadcast; each task scores its rows of the index against them
    and returns k for each query, so no vector is shuffled. A row is no neighbour of rows with its own id. Rows that `usable` leaves out take no
    part. Rows that share an id are one query, that of the least vector, and candidates each. Vectors of any finite length take part; a score that overflows
    is infinite, and one that is not a number comes last. Fewer than k candidates are all returned; an empty table gives no rows.
    """
    schema = "query_id long, vec_id long, score double"
    picked = materialize(index.where(queries).groupBy("vec_id").agg(F.min("x").alias("x")))
    parts = max(1, -(-picked.count() // spec.query_rows))
    if books is None:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = None
    block = F.pmod(F.xxhash64("vec_id"), F.lit(2 * parts if parts > 1 else 1))
    for p in range(2 * parts if parts > 1 else 1):
        got = picked.where(block == p).toArrow()  # about query_rows / 2 rows
        q_ids, q = got.column("vec_id").to_numpy(), _matrix(got.column("x").combine_chunks())
        if not len(q_ids):
            continue
        sent = index.sparkSession.sparkContext.broadcast((q_ids, q, books))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            def answer(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
                t = pa.Table.from_batches(rows).combine_chunks()
                ids, x = t.column("vec_id").to_numpy(), _matrix(t.column("x").combine_chunks())
                codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
                got = search_block(ids, x, codes, t.column("norm").to_numpy(), *sent.value[:2], sent.value[2], spec)
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], ["query_id", "vec_id", "score"])

            held: list[pa.RecordBatch] = []
            for b in batches:
                held.append(b)
                if sum(r.num_rows for r in held) >= spec.block_rows:
                    yield answer(held)
                    held = []
            if held and sum(r.num_rows for r in held):
                yield answer(held)

        part = materialize(index.mapInArrow(run, schema))
        sent.destroy()
        found = part if found is None else found.unionAll(part)
    if found is None:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= spec.k).select("query_id", "rank", "vec_id", "score")
