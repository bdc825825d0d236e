"""Extended JSON: values that JSON has no notation for, as documents of one $-key."""

from __future__ import annotations

import base64
import datetime as dt
import json
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_text
from ..plans.compiler import dialect, row_of
from ..plans.parser import Parser
from .documents import Long, json_value


def encode(x: Any) -> str:
    """The text of a Python value."""
    return json.dumps(_plain(x), ensure_ascii=False, separators=(",", ":"))


def _plain(x: Any) -> Any:
    if isinstance(x, Long):
        return {"$numberLong": str(int(x))}
    if isinstance(x, bool) or x is None or isinstance(x, (str, float)):
        return x
    if isinstance(x, int):
        return x if -(2**31) <= x < 2**31 else {"$numberLong": str(x)}
    if isinstance(x, Decimal):
        return {"$numberDecimal": str(x)}
    if isinstance(x, dt.datetime):
        return {"$date": x.strftime("%Y-%m-%dT%H:%M:%S.") + f"{x.microsecond // 1000:03d}Z"}
    if isinstance(x, (bytes, bytearray)):
        return {"$binary": base64.b64encode(x).decode()}
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return _plain(x.asDict())
    return [_plain(v) for v in x]


def decode(text: str) -> Any:
    """The value of a text; keys need no quotes."""
    p = Parser(text)
    value = json_value(p)
    if p.tok.kind != "end":
        raise p.fault("the end of the text")
    return value


def encoded(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one text, made where the row is."""
    with dialect(df.sparkSession):
        return df.select(json_text(row_of(df)).alias(name))


def write_lines(df: DataFrame, path: str) -> None:
    encoded(df, "value").where(F.col("value").isNotNull()).write.text(path)
