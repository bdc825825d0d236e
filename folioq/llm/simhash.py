"""SimHash fingerprints and near-duplicate groups by pigeonring filtering.

The ring: a 64-bit fingerprint is cut into five segments. If two fingerprints differ in at most four bits, then by
the pigeonring principle (Qin and Xiao, 2018) some segment starts a chain all of whose prefixes of length l differ in at most
floor(4 l / 5) bits: 0 in the first segment, at most 1 in the first two, 2 in three, 3 in four, 4 in all. So rows are dealt by
(first segment, its value), sorted by the next segment, and only neighbours that differ in at most one bit of the next segment are
looked at; the chain is then followed, and what is left gets the full Hamming check. No pair is lost.

The pipeline asks for copies down to a Jaccard similarity of 0.8, whose fingerprints differ in about 15 % of their bits. So there a fingerprint has
2048 bits in segments of 16, more than enough for some segment to be equal (see `Sketch`); rows are dealt by segments, checked by their Hamming
distance, and what is left is compared by shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, columns_of, materialize, materialize_texts, named, pair_tasks, spare
from .components import components

#: Fixed by the ring: segment widths, and the differing bits allowed after l segments of a chain.
WIDTHS = (13, 13, 13, 13, 12)
BUDGETS = (0, 1, 2, 3, 4)
OFFSETS = tuple(accumulate((0, *WIDTHS[:-1])))
MASKS = np.array([((1 << w) - 1) << o for w, o in zip(WIDTHS, OFFSETS)], dtype=np.uint64)
SEED = 42
CHUNK = 1 << 16
#: Rows of one segment's value, and sets that share a band's value, that are compared in one task; more are split over tasks by pairs of blocks.
CROWD, SETS = 1 << 16, 512
#: A set of more shingles than these counts as several.
SHINGLES = 1 << 12
#: Blocks of SETS sets in which all that overlapping groups propose is compared at most; beyond that it goes group by group.
WHOLE = 16
#: Candidate pairs looked at together, and rows gathered before whole segment groups are searched.
PAIRS, ROWS = 1 << 21, 1 << 17
#: Of the pipeline's long fingerprints: bits of a segment, and rows of one segment's value that are compared pair by pair; more are searched from row to row.
SEGMENT, BUCKET = 16, 256


def words_of(text: str | None) -> list[bytes]:
    """Words of the text in UTF-8 with A-Z in lower case; none for null."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words joined by blanks; of all words if there are fewer; empty without words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, xx = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([xx(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = len(words) - k + 1
    return np.fromiter((xx(joined[s : e - 1], SEED) for s, e in zip(starts, ends[k - 1 :])), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """64 bits: each is 1 if it is set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def mixed(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Other 64 bits for each hash (rows) and lane (columns): the finalizer of SplitMix64 over the hash shifted by the lane's constant."""
    z = hashes[:, None] + np.arange(lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *, shingle: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and `fp`, the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(majority(shingle_hashes(words_of(t.as_py()), shingle))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    src = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Sketch:
    """How the pipeline compares documents: by SimHash fingerprints of `words` times 64 bits over the sets of their `shingle`-word shingles. A pair is
    proposed if a segment (SEGMENT bits) of its fingerprints is equal and their first `check` words differ in at most `most` bits, and linked if the Jaccard
    similarity of its shingle sets, counted in full, is `similarity` or more.

    If a share p of the bits differs, 1 - (1 - (1 - p)^16)^128 of the pairs have an equal segment. At a similarity of 0.8 p is 0.154 at most, whatever the
    edit that parts the texts. Only in sets of few shingles, where one decides more bits, p is up to 0.188: sets of at most `few` have `more` words.
    The segments of the `first` words come in a round of their own."""

    words: int = 32
    few: int = 64
    more: int = 64
    first: int = 4
    check: int = 3
    most: int = 60
    shingle: int = 5
    similarity: float = 0.8


def long_fingerprint(shingles: np.ndarray, sketch: Sketch) -> np.ndarray:
    """The fingerprint of a set of shingles (sorted hashes) in words of 64 bits; none without shingles. Each word is the majority of other hashes of the shingles:
    a bit is 1 if it is set in over half of them."""
    n = len(shingles)
    if not n:
        return np.zeros(0, np.uint64)
    words = sketch.more if n <= sketch.few else sketch.words
    bits = lambda part: np.unpackbits(mixed(part, words).view(np.uint8), axis=1, bitorder="little")
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, n, 255):
        ones += bits(shingles[i : i + 255]).sum(axis=0, dtype=np.uint8)
    return np.packbits(ones > n // 2, bitorder="little").view(np.uint64)


def set_id(shingles: np.ndarray) -> int:
    """A hash of a set of shingles."""
    return signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))


def sketches(keyed: DataFrame, sketch: Sketch) -> DataFrame:
    """`keyed` (k, z, text) without its texts, but with the id of each one's shingle set and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps = [], []
            for t in b.column(2):
                shingles = np.unique(shingle_hashes(words_of(t.as_py()), sketch.shingle))
                ids.append(set_id(shingles))
                fps.append(long_fingerprint(shingles, sketch).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(ids, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], ["k", "z", "id", "fp"])

    return keyed.mapInArrow(run, "k long, z boolean, id long, fp array<long>")


def shingle_sets(keyed: DataFrame, sketch: Sketch) -> DataFrame:
    """id and shingles (sorted, distinct hashes) of the texts of `keyed` (k, z, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(words_of(t.as_py()), sketch.shingle)) for t in b.column(2)]
            cols = [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "shingles"])

    return keyed.mapInArrow(run, "id long, shingles array<long>")


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Labels of the components of all pairs of `sets` (distinct values, none empty) whose Jaccard similarity is `similarity` or more.

    From each set found, those not yet found are compared in full; so sets that are all alike are looked at once."""
    size = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(flat, np.cumsum(size)[:-1])
    label, rest, mark = np.arange(len(sets)), np.arange(len(sets)), np.zeros(len(values), bool)
    starts = np.cumsum(size) - size
    while len(rest) > 1:
        seed, found = rest[0], [rest[0]]
        flat, starts, rest = flat[size[seed] :], starts[1:] - size[seed], rest[1:]
        while found and len(rest):
            x = found.pop()
            mark[parts[x]] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[parts[x]] = False
            near = both >= similarity * (size[rest] + size[x] - both) - 1e-9
            if near.any():
                label[rest[near]] = seed
                found += rest[near].tolist()
                flat, rest = flat[np.repeat(~near, size[rest])], rest[~near]
                starts = np.cumsum(size[rest]) - size[rest]
    return label


def shingle_links(members: DataFrame, sets: DataFrame, sketch: Sketch) -> DataFrame:
    """Edges (u, v) between ids that join the components of all pairs that share a value and are alike. members: (b, id), sets: (id, n, shingles)."""
    sized = members.join(broadcast_if_small(sets.select("id", "n")), "id")
    split = pair_tasks(sized, F.col("b"), F.col("id"), SETS, F.greatest(F.lit(1.0), F.col("n") / SHINGLES)).drop("n")
    rows = split.join(sets, "id").select(F.xxhash64("b", "pair").alias("b"), "id", "shingles").repartition("b").sortWithinPartitions("b")

    def found(ids: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        label = alike(sets, sketch.similarity)
        return ((ids[i], ids[label[i]]) for i in np.flatnonzero(label != np.arange(len(label))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, ids, sets, edges = None, [], [], []
        done = lambda: pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["u", "v"])
        for batch in batches:
            for b, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b != value:
                    edges += found(ids, sets) if len(ids) > 1 else ()
                    value, ids, sets = b, [], []
                ids.append(i)
                sets.append(s.values.to_numpy())
            yield done()
            edges = []
        edges += found(ids, sets) if len(ids) > 1 else ()
        yield done()

    return rows.mapInArrow(run, "u long, v long")


def _rooted(df: DataFrame, roots: DataFrame | None, column: str, root: str) -> DataFrame:
    """`df` with `root`: what `roots` (node, root) has for `column`, otherwise the same as `column`."""
    if roots is None:
        return df.withColumn(root, F.col(column))
    known = broadcast_if_small(roots.select(F.col("node").alias(column), F.col("root").alias("__root")))
    return df.join(known, column, "left").withColumn(root, F.coalesce("__root", column)).drop("__root")


def proposal_components(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(id, rows, part) of the ids that are proposed with unlike ones, those that `roots` (node, root) has not joined: in how many groups an id is, and the component
    of all groups that overlap, or whose ids are joined. members: (b, id, lead)."""
    pairs = _rooted(_rooted(members.where("id <> lead").select("id", "lead").distinct(), roots, "id", "u"), roots, "lead", "v")
    parts = materialize(components(pairs.where("u <> v").select("u", "v")))
    parts = broadcast_if_small(parts.select(F.col("node").alias("__u"), F.col("root").alias("part")))
    ids = _rooted(members.groupBy("id").agg(F.count(F.lit(1)).alias("rows")), roots, "id", "u")
    return materialize(ids.join(parts, F.col("u") == F.col("__u")).select("id", "rows", "part"))


def looked_at(members: DataFrame, wholes: DataFrame, sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(b, id): the groups whose pairs are to be compared. A component of `wholes` (id, rows, part) is one group, which has all pairs of the groups of `members`
    (b, id, lead) in it, and more. Where it would take over WHOLE blocks, or more rows than its groups have, these stay as they are: those that bring unlike
    components together, and of groups of the same members one. sets: (id, n, shingles)."""
    sized = wholes.join(broadcast_if_small(sets.select("id", "n")), "id")
    blocks = F.ceil(F.sum(F.greatest(F.lit(1.0), F.col("n") / SHINGLES)) / SETS)
    sums = sized.groupBy("part").agg(F.count(F.lit(1)).alias("ids"), F.sum("rows").alias("rows"), blocks.alias("blocks"))
    large = materialize(sums.where((F.col("blocks") > WHOLE) | (F.col("ids") * F.col("blocks") > F.col("rows"))).select("part"))
    if large.isEmpty():
        return wholes.select(F.col("part").alias("b"), "id")
    one = wholes.join(broadcast_if_small(large), "part", "left_anti").select(F.col("part").alias("b"), "id")
    rest = members.join(broadcast_if_small(materialize(wholes.join(broadcast_if_small(large), "part", "left_semi").select("id"))), "id", "left_semi")
    rest = materialize(_rooted(rest.select("b", "id"), roots, "id", "root"))
    who = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    groups = rest.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), *who).where("lo <> hi")
    unlike = materialize(groups.groupBy("n", "x1", "x2").agg(F.min("b").alias("b")).select("b"))
    return materialize(one.unionByName(rest.join(broadcast_if_small(unlike), "b", "left_semi").select("b", "id")))


def shingle_components(slim: DataFrame, keyed: DataFrame, sketch: Sketch) -> DataFrame:
    """(node, root) of the components of all pairs of ids that their fingerprints propose and that are alike. slim: (k, z, id, fp), keyed: (k, z, text).

    Segments are looked at in two rounds. What the first round has joined has nothing to add, so the second looks only at what brings unlike components
    together. The groups that overlap are looked at as one, in which an id comes once and not once for each of its segments, unless that one is too large.
    Shingles are made anew from the texts, but only of one text for each id that is looked at.
    """
    prints = materialize(slim.groupBy("id").agg(F.first("fp").alias("fp")))
    reps = materialize(slim.groupBy("id").agg(F.min(F.struct("z", "k")).alias("rep")))
    edges, roots = [], None
    for words in ((0, sketch.first), (sketch.first, max(sketch.words, sketch.more))):
        members = materialize(proposed(prints, sketch, *words))
        wholes = proposal_components(members, roots)
        wanted = materialize(reps.join(wholes.select("id"), "id", "left_semi").select("id", "rep.k", "rep.z"))
        texts = keyed.join(broadcast_if_small(wanted.select("k", "z").distinct()), ["k", "z"], "left_semi")
        sets = shingle_sets(texts, sketch).join(broadcast_if_small(wanted.select("id")), "id", "left_semi")
        sets = sets.groupBy("id").agg(F.first("shingles").alias("shingles"))
        sets = materialize_texts(sets.select("id", F.size("shingles").alias("n"), "shingles"))
        edges.append(materialize_texts(shingle_links(looked_at(members, wholes, sets, roots), sets, sketch)))
        roots = materialize(components(edges[0] if len(edges) == 1 else edges[0].unionAll(edges[1])))
    return roots


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i]; label[x] is the least position in x's component."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _pairs(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of `a` with every position from its `lo` to before its `hi`, about PAIRS at a time."""
    size = hi - lo
    keep = size > 0
    a, lo, size = a[keep], lo[keep], size[keep]
    upto = np.cumsum(size)
    at = 0
    while at < len(a):
        base = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
        x = np.repeat(a[at:to], size[at:to])
        off = np.arange(len(x)) - np.repeat(upto[at:to] - size[at:to] - base, size[at:to])
        yield x, np.repeat(lo[at:to], size[at:to]) + off
        at = to


def segment_links(keys: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Positions' labels after all links among rows of one key whose `words` (n x words) differ in at most `most` bits. keys: sorted."""
    n = len(keys)
    label, me, end = np.arange(n), np.arange(n), np.searchsorted(keys, keys, "right")
    size = end - np.searchsorted(keys, keys, "left")
    few = size <= BUCKET
    for x, y in _pairs(me[few], me[few] + 1, end[few]):
        near = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in words.T) <= most
        _merge(label, x[near], y[near])
    at = 0 if few.all() else int(np.argmin(few))
    while at < n:
        if few[at]:
            at = int(end[at])
            continue
        rest, at = np.arange(at, end[at]), int(end[at])
        while len(rest) > 1:  # from each row found, those not yet found are looked at
            seed, found, rest = rest[0], [rest[0]], rest[1:]
            while found and len(rest):
                near = np.bitwise_count(words[rest] ^ words[found.pop()]).sum(axis=1, dtype=np.int64) <= most
                if near.any():
                    label[rest[near]] = seed
                    found += rest[near].tolist()
                    rest = rest[~near]
    return label


def ring_links(keys: np.ndarray, fps: np.ndarray, more: np.ndarray, most_more: int) -> np.ndarray:
    """Positions' labels after all links among rows that share a chain's first segment.

    keys, sorted: which pair of blocks, lane, first segment, its value, and in the lowest 13 bits the next segment's value. fps: the ring's
    fingerprint (unsigned). more: further bits of each row (n x lanes), of which a linked pair differs in at most most_more.
    """
    n = len(keys)
    label = np.arange(n)
    first = ((keys >> 26) & 7).astype(np.int64)
    chain = {l: np.array([np.bitwise_or.reduce(MASKS[[(i + j) % 5 for j in range(l)]]) for i in range(5)]) for l in (3, 4)}
    width = np.array([WIDTHS[(i + 1) % 5] for i in range(5)])[first]
    me = np.arange(n)

    def look(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        for x, y in _pairs(a, lo, hi):
            diff = fps[x] ^ fps[y]
            ok = np.ones(len(x), bool)
            for l, masks in chain.items():
                ok &= np.bitwise_count(diff & masks[first[x]]) <= BUDGETS[l - 1]
            ok &= np.bitwise_count(diff) <= BUDGETS[4]
            x, y = x[ok], y[ok]
            if more.shape[1]:
                ok = np.bitwise_count(more[x] ^ more[y]).sum(axis=1, dtype=np.int64) <= most_more
                x, y = x[ok], y[ok]
            _merge(label, x, y)

    look(me, me + 1, np.searchsorted(keys, keys, "right"))
    for bit in range(max(WIDTHS)):
        a = me[((keys >> bit) & 1 == 0) & (bit < width)]
        other = keys[a] | (1 << bit)
        look(a, np.searchsorted(keys, other, "left"), np.searchsorted(keys, other, "right"))
    return label


def _whole_groups(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.Table]:
    """Batches sorted by their first column gathered to about ROWS rows, so that all rows that share it but for its lowest `bits` bits come together."""
    kept: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        kept.append(b)
        n += b.num_rows
        if n >= ROWS:
            t = pa.Table.from_batches(kept)
            group = t.column(0).to_numpy() >> bits
            cut = int(np.searchsorted(group, group[-1], "left"))  # the last group may go on
            if cut:
                yield t.slice(0, cut)
                kept, n = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
    if n:
        yield pa.Table.from_batches(kept)


def proposed(prints: DataFrame, sketch: Sketch, lo: int, hi: int) -> DataFrame:
    """(b, id, lead): groups, of two ids or more, of the ids that a segment of the fingerprints' words lo to before hi proposes as pairs, one with another or through others
    that have the same segment; lead is the least id of the group. prints: (id, fp), distinct ids."""
    per = 64 // SEGMENT
    check = [F.col("fp")[i].alias(f"c{i}") for i in range(sketch.check)]
    dealt = prints.select("id", *check, F.posexplode(F.slice("fp", lo + 1, hi - lo)).alias("word", "w"))
    cut = lambda i: F.shiftrightunsigned("w", SEGMENT * i).bitwiseAND((1 << SEGMENT) - 1).cast("int")
    keys = F.array(*[F.shiftleft(F.col("word") * per + i, SEGMENT) + cut(i) for i in range(per)])
    dealt = dealt.select(F.explode(keys).alias("key"), "id", *[f"c{i}" for i in range(sketch.check)]).repartition("key").sortWithinPartitions("key", "id")

    def found(t: pa.Table) -> pa.RecordBatch:
        key, ids, *words = (c.to_numpy() for c in t.columns)
        label = segment_links(key, np.stack(words, axis=1).view(np.uint64), sketch.most)
        some = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
        lead = ids[label[some]]
        group = mixed(lead.view(np.uint64) ^ mixed(key[some].astype(np.uint64), 1)[:, 0], 1)[:, 0]
        return pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), pa.array(ids[some]), pa.array(lead)], ["b", "id", "lead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (found(t) for t in _whole_groups(batches, 0))

    return dealt.mapInArrow(run, "b long, id long, lead long")


def links(nodes: DataFrame, lanes: int = 1, most_more: int = 0) -> DataFrame:
    """Edges (u, v) between node ids that join exactly the components of all links.

    nodes: id (long, distinct), w (array of `lanes` fingerprints), s (array of further bits, may be empty). Each row
    is dealt out 5 * lanes times, by a segment and its value; a task joins what it finds and returns, for each
    row that is not the first of its component there, one edge: never all pairs of a group. A segment's value that more than CROWD rows
    have is split over several tasks.
    """
    seg = lambda fp, i: F.shiftrightunsigned(fp, OFFSETS[i]).bitwiseAND((1 << WIDTHS[i]) - 1)

    def dealt_as(lane: int) -> Column:
        fp = F.col("w")[lane]
        keys = [F.lit((lane << 29) | (i << 26)) + F.shiftleft(seg(fp, i), 13) + seg(fp, (i + 1) % 5) for i in range(5)]
        return F.array(*[F.struct(k.alias("k"), fp.alias("fp")) for k in keys])

    rows = F.concat(*[dealt_as(lane) for lane in range(lanes)])
    dealt = nodes.select("id", "s", F.explode(rows).alias("x")).select(F.col("x.k").alias("k"), F.col("x.fp").alias("fp"), "id", "s")
    dealt = pair_tasks(dealt, F.shiftright("k", 13), F.col("id"), CROWD)
    dealt = dealt.select((F.shiftleft("pair", 40) + F.col("k")).alias("k"), "fp", "id", "s")
    dealt = dealt.repartition(F.expr("shiftright(k, 13)")).sortWithinPartitions("k")

    def found(batch: pa.Table) -> pa.RecordBatch:
        k, fp, ids = (batch.column(c).to_numpy() for c in ("k", "fp", "id"))
        s = batch.column("s").combine_chunks()
        more = s.flatten().to_numpy().view(np.uint64).reshape(len(k), -1) if len(s.flatten()) else np.zeros((len(k), 0), np.uint64)
        label = ring_links(k, fp.view(np.uint64), more, most_more)
        other = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(ids[label[other]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (found(t) for t in _whole_groups(batches, 13))

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, shingle: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of `docs`.

    Fingerprints within 4 bits are linked; component_id is the least doc_id that links reach. Copies are merged by
    fingerprint before any search. Null and empty texts (and texts of blanks) have fingerprint zero and are linked
    like any other; ties need no rule, as a component's least id is unique; null ids get their component's id and never
    become one (null if all ids are null); repeated rows are returned as often as they come. An empty table gives
    no rows; other columns are not read.
    """
    slim = materialize_texts(fingerprints(docs, shingle=shingle, text=text, doc_id=doc_id))
    reps = materialize(slim.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    nodes = reps.select(F.col("fp").alias("id"), F.array("fp").alias("w"), F.array().cast("array<long>").alias("s"))
    told = _component_ids(reps.withColumnRenamed("fp", "id"), components(links(nodes)))
    out = slim.join(told.withColumnRenamed("id", "fp"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _component_ids(reps: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, component_id) for every id of `reps` (id, rep): the least rep of the id's component."""
    roots = materialize(roots)
    joined = materialize(reps.join(roots.withColumnRenamed("node", "id"), "id", "left"))
    least = materialize(joined.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("least")))
    out = joined.join(least, "root", "left")
    return materialize(out.select("id", F.coalesce("least", "rep").alias("component_id")))


def _marked(docs: DataFrame, sketch: Sketch, text: str, doc_id: str) -> DataFrame:
    """For every row: its key (k, z) and the least key of its group (ck, cz). The key is the id, and z false; without an
    id it is a hash of the text, and z true, so that such rows come after all others."""
    k, z = row_key(doc_id, text)
    keyed = docs.select(k.alias("k"), z.alias("z"), named(text).cast("string").alias("text"))
    slim = materialize_texts(sketches(keyed, sketch))
    reps = materialize(slim.groupBy("id").agg(F.min(F.struct("z", "k")).alias("rep")))
    told = _component_ids(reps, shingle_components(slim, keyed, sketch))
    out = slim.select("k", "z", "id").join(told, "id")
    return out.select("k", "z", F.col("component_id.k").alias("ck"), F.col("component_id.z").alias("cz"))


def row_key(doc_id: str, text: str) -> tuple[Column, Column]:
    """A row's id, or without one a hash of its text; and whether it has none."""
    return F.coalesce(named(doc_id).cast("long"), F.xxhash64(named(text).cast("string"))), named(doc_id).isNull()


def near_groups(docs: DataFrame, sketch: Sketch = Sketch(), *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and component_id, by `sketch`; nulls, ties, repeated rows and empty tables as for near_duplicates."""
    marked = _marked(docs, sketch, text, doc_id)
    return marked.select(F.when(~F.col("z"), F.col("k")).alias("doc_id"), F.when(~F.col("cz"), F.col("ck")).alias("component_id"))


def deduplicated(docs: DataFrame, sketch: Sketch = Sketch(), *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs`, with all its columns, whatever their names, and one row of each group: that with the least doc_id, or if all its ids are null that
    with the least hash of its text. Of rows with one id one stays, that with the least hash of its text and then of its other columns, so that reruns
    agree; documents without words form one group, null texts among them. An empty table gives no rows.

    Only keys are shuffled: the rows that go are few beside those that stay, and are broadcast if a count shows that they fit. Beyond that the
    texts are shuffled once, by key.
    """
    marked = _marked(docs, sketch, text, doc_id)
    first = (F.col("k") == F.col("ck")) & (F.col("z") == F.col("cz"))
    keys = materialize(marked.groupBy("k", "z").agg(F.max(first).alias("first"), F.count(F.lit(1)).alias("n")))
    kn, zn, rk, rz, row = spare(docs, "__k", "__z", "__rk", "__rz", "__row")
    key = lambda df: df.select(F.col("k").alias(kn), F.col("z").alias(zn))
    again = key(keys.where("first AND n > 1"))
    k, z = row_key(doc_id, text)
    here = (k == F.col(kn)) & (z == F.col(zn))
    out = docs.join(broadcast_if_small(key(keys.where("NOT first OR n > 1"))), here, "left_anti")
    if again.isEmpty():
        return out
    hashed = [named(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no order, hence no hash
    least = F.min_by(F.struct(*columns_of(docs)), F.struct(F.xxhash64(named(text)), F.xxhash64(*hashed)))
    some = docs.join(broadcast_if_small(again), here, "left_semi")
    return out.unionAll(some.groupBy(k.alias(rk), z.alias(rz)).agg(least.alias(row)).select(f"{row}.*"))
