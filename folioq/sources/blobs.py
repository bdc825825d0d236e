"""File storage: contents as chunk rows, with a row of facts for each file."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 255 * 1024


def upload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(_files, _chunks) for the files that a path or glob names, cut where they are read."""
    src = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return stored(src.select(F.col("path").alias("_id"), name.alias("filename"), "content", F.col("modificationTime").alias("uploadDate")))


def stored(contents: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(_files, _chunks) for rows of _id, filename, content (binary) and, where they are there, uploadDate and metadata (text). Empty and null contents have
    no chunks. A name without a known ending is a stream of bytes."""
    src = contents.withColumn("length", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"))
    chunks = F.ceil(F.col("length") / chunk).cast("int")
    date = F.col("uploadDate") if "uploadDate" in src.columns else F.current_timestamp()
    facts = F.col("metadata").cast("string") if "metadata" in src.columns else F.lit(None).cast("string")
    files = src.select("_id", "filename", "length", chunks.alias("chunks"), date.alias("uploadDate"), facts.alias("metadata"))
    files = files.join(F.broadcast(_mimes(files)), F.lower(F.element_at(F.split("filename", r"\."), -1)) == F.col("ext"), "left")
    files = files.select("_id", "filename", F.coalesce("mime", F.lit("application/octet-stream")).alias("mimeType"), "length", "chunks", "uploadDate", "metadata")
    parts = src.where("length > 0").select(F.col("_id").alias("f"), "content", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("n"))
    data = F.substring("content", F.col("n") * chunk + 1, F.lit(chunk))
    return files, parts.select(F.struct("f", "n").alias("_id"), data.alias("data"))


def contents(files: DataFrame, chunks: DataFrame, start: int = 0, length: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """_id and content of every file, or of each `length` bytes from `start` on: only chunks that hold some of these are read. Empty beyond the end.
    One row holds what is asked of one file; for files larger than a task's memory ask for ranges, or use `download`."""
    first, last = start // chunk, None if length is None else (start + length - 1) // chunk
    parts = chunks.where(F.col("_id.n") >= first)
    if last is not None:
        parts = parts.where(F.col("_id.n") <= last)
    whole = parts.groupBy(F.col("_id.f").alias("f")).agg(F.array_sort(F.collect_list(F.struct(F.col("_id.n").alias("n"), "data"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x.data))
    cut = F.substring(joined, start - first * chunk + 1, 2**31 - 1 if length is None else length)
    return files.select("_id").join(whole.select("f", cut.alias("content")), F.col("_id") == F.col("f"), "left").select("_id", F.coalesce("content", F.lit(b"")).alias("content"))


def deleted(files: DataFrame, chunks: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """Both without the files for which `where`, over the facts of a file, is true."""
    left = files.where(~F.coalesce(where, F.lit(False)))
    return left, chunks.join(left.select(F.col("_id").alias("__f")), F.col("_id.f") == F.col("__f"), "left_semi")


def with_metadata(files: DataFrame, where: Column, metadata: Column | str | None) -> DataFrame:
    """The files with `metadata` (a JSON text) set for those for which `where` is true."""
    value = metadata if isinstance(metadata, Column) else F.lit(metadata).cast("string")
    return files.withColumn("metadata", F.when(where, value).otherwise(F.col("metadata")))


def _mimes(files: DataFrame) -> DataFrame:
    rows = sorted((ext.lstrip("."), kind) for ext, kind in mimetypes.types_map.items())
    return files.sparkSession.createDataFrame(rows, "ext string, mime string")


def download(chunks: DataFrame, file_id: str):
    """The file's bytes, chunk by chunk in order."""
    for row in chunks.where(F.col("_id.f") == file_id).orderBy("_id.n").select("data").toLocalIterator():
        yield bytes(row.data)
