"""Documents from Python values and lenient JSON, as typed frames."""

from __future__ import annotations

import base64
import datetime as dt
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SyntaxFault
from ..functions.values import Val, common, fitted
from ..plans.ast import Arr, Doc, Lit, Node
from ..plans.parser import Parser


def type_of(x: Any) -> T.DataType:
    if x is None:
        return T.NullType()
    if isinstance(x, bool):
        return T.BooleanType()
    if isinstance(x, Long):
        return T.LongType()
    if isinstance(x, int):
        return T.IntegerType() if -(2**31) <= x < 2**31 else T.LongType()
    if isinstance(x, float):
        return T.DoubleType()
    if isinstance(x, Decimal):
        return T.DecimalType(38, 18)
    if isinstance(x, str):
        return T.StringType()
    if isinstance(x, (bytes, bytearray)):
        return T.BinaryType()
    if isinstance(x, (dt.datetime, dt.date)):
        return T.TimestampType()
    if isinstance(x, dict):
        return T.StructType([T.StructField(str(k), type_of(v)) for k, v in x.items()])
    if isinstance(x, (list, tuple)):
        return T.ArrayType(common([type_of(y) for y in x]))
    raise SyntaxFault(f"no document value for a {type(x).__name__}")


class Long(int):
    """A whole number that stays 64 bits wide."""


def _fit(x: Any, t: T.DataType) -> Any:
    """A Python value as Spark takes it for a type."""
    if x is None:
        return None
    if isinstance(t, T.StructType):
        low = {str(k).lower(): v for k, v in x.items()}
        return tuple(_fit(low.get(f.name.lower()), f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return [_fit(y, t.elementType) for y in x]
    if isinstance(t, T.DoubleType):
        return float(x)
    if isinstance(t, T.DecimalType):
        return Decimal(str(x))
    if isinstance(t, T.StringType):
        return x if isinstance(x, str) else str(x)
    if isinstance(t, T.TimestampType) and not isinstance(x, dt.datetime):
        return dt.datetime(x.year, x.month, x.day)
    return int(x) if isinstance(x, Long) else x


def stored_type(t: T.DataType) -> T.DataType:
    """Parquet has no column of nothing: what was null everywhere is kept as text."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, stored_type(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(stored_type(t.elementType))
    return t


def frame_of(spark: SparkSession, docs: list[dict[str, Any]]) -> DataFrame:
    """A frame with the union of the documents' fields, each of the type that fits all its values."""
    t = common([type_of(d) for d in docs]) if docs else T.StructType([])
    t = t if isinstance(t, T.StructType) else T.StructType([])
    t = stored_type(t)
    return spark.createDataFrame([_fit(d, t) for d in docs], t)


def literal(n: Node) -> Any:
    """The Python value of a JSON node; expressions are refused."""
    if isinstance(n, Lit):
        return Long(n.value) if n.kind == "long" else n.value
    if isinstance(n, Arr):
        return [literal(x) for x in n.items]
    if isinstance(n, Doc):
        if len(n.items) == 1 and n.items[0][0].startswith("$"):
            key, value = n.items[0][0], literal(n.items[0][1])
            if key == "$numberLong":
                return Long(value)
            if key == "$numberDecimal":
                return Decimal(str(value))
            if key == "$date":
                return dt.datetime.fromisoformat(str(value).replace("Z", "+00:00")).astimezone(dt.timezone.utc).replace(tzinfo=None)
            if key == "$binary":
                return base64.b64decode(value)
            if key in ("$oid", "$guid"):
                return str(value)
        return {k: literal(v) for k, v in n.items}
    raise SyntaxFault(f"JSON takes no expression: {n}")


def json_value(p: Parser) -> Any:
    return literal(p.single())


def union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that some lack is null there, and types widen to hold all."""
    if len(frames) == 1:
        return frames[0]
    kinds: dict[str, tuple[str, list[T.DataType]]] = {}
    for f in frames:
        for c in f.schema.fields:
            kinds.setdefault(c.name.lower(), (c.name, []))[1].append(c.dataType)
    out = None
    for f in frames:
        has = {c.name.lower(): c for c in f.schema.fields}
        cols = []
        for low, (name, types) in kinds.items():
            t = common(types)
            col = fitted(Val(F.col(f"`{has[low].name}`"), has[low].dataType), t) if low in has else F.lit(None).cast(t)
            cols.append(col.alias(name))
        part = f.select(*cols)
        out = part if out is None else out.unionAll(part)
    return out
