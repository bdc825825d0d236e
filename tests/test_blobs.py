import pytest
from pyspark.sql import functions as F

from folioq.sources import blobs


@pytest.fixture
def kept(spark):
    rows = [("a", "a.HTML", b"0123456789"), ("b", "b", b""), ("c", "c.x.json", None), ("d", "d.nothing", bytes(range(256)))]
    return blobs.stored(spark.createDataFrame(rows, "_id string, filename string, content binary"), 4)


def told(df):
    return {r._id: bytes(r.content) for r in df.collect()}


def test_facts(kept):
    got = {r._id: (r.mimeType, r.length, r.chunks, r.metadata) for r in kept[0].collect()}
    other = "application/octet-stream"
    assert got == {"a": ("text/html", 10, 3, None), "b": (other, 0, 0, None), "c": ("application/json", 0, 0, None), "d": (other, 256, 64, None)}


def test_contents_and_ranges(kept):
    files, chunks = kept
    whole = told(blobs.contents(files, chunks, chunk=4))
    assert whole == {"a": b"0123456789", "b": b"", "c": b"", "d": bytes(range(256))}
    for start, length in [(0, 1), (3, 2), (4, 4), (2, 9), (9, 100), (10, 5), (255, 1), (300, 5), (7, None)]:
        part = told(blobs.contents(files, chunks, start, length, 4))
        assert part == {k: v[start:][:length] for k, v in whole.items()}, (start, length)
    assert b"".join(blobs.download(chunks, "a")) == b"0123456789"


def test_deleted_files_take_their_chunks_along(kept):
    files, chunks = blobs.deleted(blobs.with_metadata(kept[0], F.col("length") > 5, '{"big":1}'), kept[1], F.col("_id") == "d")
    assert {r._id: r.metadata for r in files.collect()} == {"a": '{"big":1}', "b": None, "c": None}
    assert sorted(r._id.n for r in chunks.collect()) == [0, 1, 2]
    files, chunks = blobs.deleted(*kept, F.col("metadata") == "x")  # null is not true
    assert files.count() == 4 and chunks.count() == 67


def test_empty(spark):
    files, chunks = blobs.stored(spark.createDataFrame([], "_id long, filename string, content binary"))
    assert files.count() == chunks.count() == blobs.contents(files, chunks).count() == 0
