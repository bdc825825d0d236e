"""Expiry: documents whose time has come are deleted."""

from __future__ import annotations

import datetime as dt
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import Scope, compile_node, row_of
from ..plans.parser import parse

if TYPE_CHECKING:
    from ..database import Database


def expired(df: DataFrame, expr: str, now: dt.datetime | None = None) -> DataFrame:
    """Rows for which the expression is an instant that is not after `now`; other values never expire."""
    v = compile_node(parse(expr), Scope(row_of(df)))
    if v.kind != "date":
        return df.where(F.lit(False))
    return df.where(v.col.cast("timestamp") <= (F.lit(now) if now else F.current_timestamp()))


def sweep(database: Database, name: str, expr: str, now: dt.datetime | None = None) -> int:
    """Delete what has expired; the number of documents. Call it from a scheduler."""
    df = database.find(name)
    if df is None or compile_node(parse(expr), Scope(row_of(df))).kind != "date":
        return 0
    at = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return database.delete_many(name, f"({expr}) <= @now AND ({expr}) != null", {"now": at})


def live(stream: DataFrame, at: str, keep: str) -> DataFrame:
    """A stream without rows older than `keep` ("1 hour") against the newest seen: state behind it expires with the watermark."""
    return stream.withWatermark(at, keep)
