"""Infix operators on typed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindFault
from .library import BOOL, DATE, DOUBLE, LONG, contains
from .text import to_text
from .values import NUMBERS, Val, common, equal, less, more, null

DECIMAL = T.DecimalType(38, 18)


def _wide(a: Val, b: Val) -> T.DataType:
    return common([a.type, b.type]) if "double" not in (a.kind, b.kind) else DOUBLE


def _ticks(d: Val, n: Val, sign: int) -> Val:
    """An instant moved by a number of 100 ns, then cut to milliseconds."""
    micros = F.unix_micros(d.col.cast(DATE)) + F.floor(n.col * sign / 10).cast("long")
    return Val(F.date_trunc("MILLISECOND", F.timestamp_micros(micros)), DATE)


def plus(a: Val, b: Val) -> Val:
    if "string" in (a.kind, b.kind):
        return Val(F.concat(to_text(a), to_text(b)), T.StringType())
    if a.kind == "date" and b.kind in NUMBERS:
        return _ticks(a, b, 1)
    if b.kind == "date" and a.kind in NUMBERS:
        return _ticks(b, a, 1)
    return _number(a, b, lambda x, y: x + y)


def minus(a: Val, b: Val) -> Val:
    if a.kind == "date" and b.kind in NUMBERS:
        return _ticks(a, b, -1)
    if b.kind == "date" and a.kind in NUMBERS:
        return _ticks(b, a, -1)
    if a.kind == b.kind == "date":
        return Val((F.unix_micros(a.col.cast(DATE)) - F.unix_micros(b.col.cast(DATE))) * 10, LONG)
    return _number(a, b, lambda x, y: x - y)


def _number(a: Val, b: Val, make: Callable[[Column, Column], Column]) -> Val:
    """Whole numbers of one type wrap around."""
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        return null()
    t = _wide(a, b)
    return Val(make(a.col.cast(t), b.col.cast(t)).cast(t), t)


def times(a: Val, b: Val) -> Val:
    return _number(a, b, lambda x, y: x * y)


def divide(a: Val, b: Val) -> Val:
    """A double, unless there is a decimal; by zero: infinite, or NaN for 0/0."""
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        return null()
    if "decimal" in (a.kind, b.kind) and "double" not in (a.kind, b.kind):
        return Val((a.col.cast(DECIMAL) / b.col.cast(DECIMAL)).cast(DECIMAL), DECIMAL)
    x, y = a.col.cast(DOUBLE), b.col.cast(DOUBLE)
    if b.known_not_null and b.literal[0]:
        return Val(x / y, DOUBLE)
    over_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
    return Val(F.when(F.isnan(x), x).when(y == 0, over_zero).otherwise(x / y), DOUBLE)


def remainder(a: Val, b: Val) -> Val:
    """Of whole numbers of one type whole (by zero: null); else a double (by zero: NaN)."""
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        return null()
    if a.kind == b.kind and a.kind in ("int", "long"):
        return Val(F.when(b.col != 0, a.col % F.when(b.col != 0, b.col)), a.type)
    x, y = a.col.cast(DOUBLE), b.col.cast(DOUBLE)
    return Val(F.when(y == 0, F.when(x.isNotNull(), F.lit(float("nan")))).otherwise(x % F.when(y != 0, y)), DOUBLE)


def like(a: Val, b: Val) -> Val:
    """% and _ only: a backslash is itself."""
    if a.kind != "string" or b.kind != "string":
        return Val(F.lit(False), BOOL)
    if b.literal:
        return Val(F.coalesce(a.col.like(str(b.literal[0]).replace("\\", "\\\\")), F.lit(False)), BOOL)
    return Val(F.coalesce(F.like(a.col, F.replace(b.col, F.lit("\\"), F.lit("\\\\"))), F.lit(False)), BOOL)


def vector_distance(a: Val, b: Val) -> Val:
    """Cosine distance; null if lengths differ, for a zero vector, and where a number is missing."""
    if a.kind != "array" or b.kind != "array":
        return null(DOUBLE)
    x = F.transform(a.col, lambda v: v.cast("float").cast(DOUBLE))
    y = b.col.cast(T.ArrayType(DOUBLE))
    return Val(1 - _cosine(x, y), DOUBLE)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def _cosine(x: Column, y: Column) -> Column:
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    cos = F.when(norm > 0, dot(x, y) / norm)
    return F.when((F.size(x) == F.size(y)) & ~F.isnan(cos), cos)


def both(a: Val, b: Val) -> Val:
    _booleans("AND", a, b)
    return Val(a.col & b.col, BOOL)


def either(a: Val, b: Val) -> Val:
    _booleans("OR", a, b)
    return Val(a.col | b.col, BOOL)


def _booleans(name: str, *vals: Val) -> None:
    if any(v.kind != "bool" for v in vals):
        raise BindFault(f"{name} needs boolean operands")


def between(x: Val, low: Val, high: Val) -> Val:
    return Val(more(x, low, True) & less(x, high, True), BOOL)


BINARY: dict[str, Callable[[Val, Val], Val]] = {
    "+": plus,
    "-": minus,
    "*": times,
    "/": divide,
    "%": remainder,
    "=": lambda a, b: Val(equal(a, b), BOOL),
    "!=": lambda a, b: Val(~equal(a, b), BOOL),
    "<": lambda a, b: Val(less(a, b), BOOL),
    "<=": lambda a, b: Val(less(a, b, True), BOOL),
    ">": lambda a, b: Val(more(a, b), BOOL),
    ">=": lambda a, b: Val(more(a, b, True), BOOL),
    "LIKE": like,
    "IN": lambda a, b: contains(b, a),
    "VECTOR_SIM": vector_distance,
    "AND": both,
    "OR": either,
}
