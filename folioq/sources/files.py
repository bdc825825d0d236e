"""JSON and CSV files as sources and sinks, below a folder that paths must not leave."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FolioError
from ..functions.text import to_text
from ..functions.values import Val


@dataclass(frozen=True)
class FileRoot:
    """folder: files lie below it; None: anywhere. enabled=False: no files at all."""

    folder: str | None = None
    enabled: bool = True

    def resolve(self, name: str) -> str:
        if not self.enabled:
            raise FolioError("files are disabled")
        if self.folder is None:
            return name
        full = posixpath.normpath(posixpath.join(self.folder, name))
        if not (full + "/").startswith(posixpath.normpath(self.folder) + "/"):
            raise FolioError(f"{name!r} leaves the file folder")
        return full


def _format(options: dict[str, Any]) -> str:
    kind = str(options.get("format") or posixpath.splitext(options["filename"])[1].lstrip(".")).lower()
    if kind not in ("json", "jsonl", "csv"):
        raise FolioError(f"no file format {kind!r}")
    return kind


def read_file(spark: SparkSession, options: dict[str, Any], root: FileRoot = FileRoot()) -> DataFrame:
    """json: arrays of documents, one document over several lines, or one document a line; jsonl: one a line. csv: text columns, by the
    header or by options['header']."""
    path, kind = root.resolve(options["filename"]), _format(options)
    encoding = options.get("encoding", "utf-8")
    if kind != "csv":
        return spark.read.json(path, multiLine=kind == "json" and not _by_line(spark, path, encoding), encoding=encoding)
    names = options.get("header")
    named = isinstance(names, (list, tuple))
    df = spark.read.csv(path, header=not named, sep=options.get("delimiter", ","), quote='"', escape='"', multiLine=True, inferSchema=False, encoding=encoding)
    return df.toDF(*names) if named else df


def _by_line(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether the first line that is not blank is a whole document, which no array and no document over several lines begins with."""
    try:
        if encoding.lower().replace("-", "") != "utf8":
            return False
        first = spark.read.text(path).where(F.trim("value") != "").first()
        return first is not None and isinstance(json.loads(first.value), dict)
    except ValueError:
        return False


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's documents as the lines of one JSON array."""
    before = None
    for b in batches:
        lines = []
        for text in b.column(0).to_pylist():
            if before is not None:
                lines.append(before + ",")
            before = text if before is not None else "[" + text
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    if before is not None:
        yield pa.RecordBatch.from_arrays([pa.array([before + "]"], pa.string())], ["value"])


def _indented(text: Column, width: int) -> Column:
    """Two blanks a level, as Spark indents, as `width`."""
    if width == 2:
        return text
    lines = F.transform(F.split(text, "\n"), lambda x: F.concat(F.repeat(F.lit(" " * width), (F.length(x) - F.length(F.ltrim(x))) / 2), F.ltrim(x)))
    return F.array_join(lines, "\n")


def write_file(df: DataFrame, options: dict[str, Any], root: FileRoot = FileRoot()) -> int:
    """Rows written. The path becomes a folder of part files, each written where its rows are: of json each is an array of documents
    (with options pretty and indent, blanks a level), of jsonl documents line by line, of csv rows below a header. Without rows nothing is written."""
    path, kind = root.resolve(options["filename"]), _format(options)
    mode = "overwrite" if options.get("overwritten") else "error"
    if df.isEmpty():
        return 0
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if kind == "jsonl":
        df.write.mode(mode).json(path, encoding=options.get("encoding", "utf-8"), ignoreNullFields=False)
    elif kind == "json":
        pretty = bool(options.get("pretty"))
        text = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in df.schema.fields]), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})
        lines = df.select((_indented(text, int(options.get("indent", 2))) if pretty else text).alias("value"))
        lines.mapInArrow(_arrays, "value string").write.mode(mode).option("encoding", options.get("encoding", "utf-8")).text(path)
    else:
        flat = [to_text(Val(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
        df.select(*flat).write.mode(mode).csv(path, header=bool(options.get("header", True)), sep=options.get("delimiter", ","), nullValue="null", escape='"')
    return seen.get["n"]
