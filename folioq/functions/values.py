"""Typed values, and the total order over them.

Comparisons are two-valued: null equals null and is less than anything else, NaN is the least number, and values of
different kinds compare by kind and never fail. Where the kinds are known, that folds when the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindFault

#: Kinds in the order in which values of different kinds compare; numbers compare among themselves.
RANKS = {"min": 0, "null": 1, "int": 2, "long": 2, "double": 2, "decimal": 2, "string": 6, "doc": 7, "array": 8, "binary": 9, "bool": 12, "date": 13, "max": 14}
NUMBERS = ("int", "long", "double", "decimal")


@dataclass(frozen=True)
class Val:
    """A column with its type. seq: an array that stands for zero to many values. fields: how a document whose fields are columns
    of the table gives one. literal: the Python value, if it is known."""

    col: Column
    type: T.DataType
    seq: bool = False
    fields: Callable[[str], Column] | None = None
    literal: tuple[Any, ...] = ()

    @property
    def kind(self) -> str:
        return kind_of(self.type)

    @property
    def element(self) -> T.DataType:
        return self.type.elementType if isinstance(self.type, T.ArrayType) else T.NullType()

    @property
    def known_not_null(self) -> bool:
        return bool(self.literal) and self.literal[0] is not None


class Lowest(T.NullType):
    """The type of the value that is less than any other, null included."""


class Highest(T.NullType):
    """The type of the value that is more than any other."""


class JsonText(T.StringType):
    """Text that is JSON, or a part of one: its fields and items can be asked for, and are of this type too."""

    @classmethod
    def typeName(cls) -> str:
        return "string"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (Lowest, Highest)):
        return "min" if isinstance(t, Lowest) else "max"
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return "int"
    if isinstance(t, T.LongType):
        return "long"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(t, T.DecimalType):
        return "decimal"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, (T.StructType, T.MapType)):
        return "doc"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.BinaryType):
        return "binary"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    raise BindFault(f"no values of type {t.simpleString()}")


def null(t: T.DataType | None = None) -> Val:
    return Val(F.lit(None).cast(t) if t else F.lit(None), t or T.NullType(), literal=(None,))


def lit(x: Any) -> Val:
    """A constant; lists become arrays of their common kind."""
    if x is None:
        return null()
    if isinstance(x, bool):
        return Val(F.lit(x), T.BooleanType(), literal=(x,))
    if isinstance(x, int):
        t = T.IntegerType() if -(2**31) <= x < 2**31 else T.LongType()
        return Val(F.lit(x).cast(t), t, literal=(x,))
    if isinstance(x, float):
        return Val(F.lit(x), T.DoubleType(), literal=(x,))
    if isinstance(x, str):
        return Val(F.lit(x), T.StringType(), literal=(x,))
    if isinstance(x, (bytes, bytearray)):
        return Val(F.lit(bytes(x)), T.BinaryType(), literal=(bytes(x),))
    if isinstance(x, (list, tuple)):
        return array([lit(y) for y in x], literal=(list(x),))
    if isinstance(x, dict):
        vals = {k: lit(v) for k, v in x.items()}
        return doc(vals)
    if hasattr(x, "isoformat"):
        return Val(F.lit(x).cast("timestamp"), T.TimestampType(), literal=(x,))
    raise BindFault(f"no value for a {type(x).__name__}")


def common(kinds: list[T.DataType]) -> T.DataType:
    """The type that holds values of all these types; numbers widen, and other mixtures become text."""
    some = [k for k in kinds if not isinstance(k, T.NullType)]
    if not some:
        return T.NullType()
    if all(k == some[0] for k in some):
        return some[0]
    if any(isinstance(k, JsonText) for k in some):
        return common([T.StringType() if isinstance(k, JsonText) else k for k in some])
    names = {kind_of(k) for k in some}
    if names <= set(NUMBERS):
        if "double" in names:
            return T.DoubleType()
        if "decimal" in names:
            return T.DecimalType(38, 18)
        return T.LongType()
    if len(names) == 1 and names != {"doc"}:
        if names == {"array"}:
            return T.ArrayType(common([k.elementType for k in some]))
        return {"string": T.StringType(), "date": T.TimestampType(), "bool": T.BooleanType(), "binary": T.BinaryType()}[names.pop()]
    if names == {"doc"} and all(isinstance(k, T.StructType) for k in some):
        fields: dict[str, list] = {}
        for k in some:
            for f in k.fields:
                fields.setdefault(f.name, []).append(f.dataType)
        return T.StructType([T.StructField(n, common(ts)) for n, ts in fields.items()])
    return T.StringType()


def fitted(v: Val, t: T.DataType) -> Column:
    """The column of `v` as type `t`, which `common` gave."""
    if v.type == t:
        return v.col
    if isinstance(t, T.StructType) and isinstance(v.type, T.StructType):
        made = []
        for f in t.fields:
            own = field(v, f.name)
            made.append(fitted(own, f.dataType).alias(f.name))
        return F.when(v.col.isNotNull(), F.struct(*made))
    if isinstance(t, T.ArrayType) and isinstance(v.type, T.ArrayType):
        return F.transform(v.col, lambda x: fitted(Val(x, v.type.elementType), t.elementType))
    return v.col.cast(t)


def array(items: list[Val], seq: bool = False, literal: tuple = ()) -> Val:
    t = common([v.type for v in items])
    cols = [fitted(v, t) for v in items]
    col = F.array(*cols) if cols else F.array().cast(T.ArrayType(t))
    return Val(col, T.ArrayType(t), seq, literal=literal)


def doc(items: dict[str, Val]) -> Val:
    """A document; a later key of the same spelling, cases apart, replaces the value and keeps the place."""
    seen: dict[str, tuple[str, Val]] = {}
    for k, v in items.items():
        seen[k.lower()] = (seen[k.lower()][0] if k.lower() in seen else k, v)
    made = {k: v for k, v in seen.values()}
    t = T.StructType([T.StructField(k, v.type) for k, v in made.items()])
    return Val(F.struct(*[v.col.alias(k) for k, v in made.items()]) if made else F.struct(), t)


#: JSON as people write it: keys without quotes, and single quotes.
LENIENT = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"}


def json_fields(text: Column) -> Column:
    """A JSON document's fields as texts; null for anything else."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, T.MapType(T.StringType(), T.StringType()), LENIENT))


def json_items(text: Column) -> Column:
    """A JSON array's items as texts; null for anything else."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, T.ArrayType(T.StringType()), LENIENT))


def field(v: Val, name: str) -> Val:
    """A document's field, found in any case; null if it has none, and for what is not a document. Fields of JSON are found by their very name first."""
    if isinstance(v.type, JsonText):
        made = json_fields(v.col)
        other = F.map_values(F.map_filter(made, lambda k, _: F.lower(k) == name.lower()))
        return Val(F.coalesce(F.try_element_at(made, F.lit(name)), F.get(other, F.lit(0))), JsonText())
    if isinstance(v.type, T.StructType):
        for f in v.type.fields:
            if f.name.lower() == name.lower():
                return Val(v.fields(f.name) if v.fields else v.col.getField(f.name), f.dataType)
    if isinstance(v.type, T.MapType):
        return Val(F.try_element_at(v.col, F.lit(name)), v.type.valueType)
    return null()


# Order


def _nan(v: Val) -> bool:
    return v.kind == "double" and not (v.literal and v.literal[0] is not None and v.literal[0] == v.literal[0])


def _both(a: Val, b: Val) -> tuple[Column, Column]:
    """The columns of two numbers as one type, exactly; of others as they are."""
    if {a.kind, b.kind} <= set(NUMBERS) and a.type != b.type:
        if a.literal and isinstance(a.literal[0], int) and b.kind == "double":
            return F.lit(float(a.literal[0])), b.col
        if b.literal and isinstance(b.literal[0], int) and a.kind == "double":
            return a.col, F.lit(float(b.literal[0]))
        t = common([a.type, b.type])
        return a.col.cast(t), b.col.cast(t)
    return a.col, b.col


EDGES = {"min", "max"}


def equal(a: Val, b: Val) -> Column:
    if EDGES & {a.kind, b.kind}:
        return F.lit(a.kind == b.kind)
    if RANKS[a.kind] != RANKS[b.kind]:
        if "null" in (a.kind, b.kind):
            return (b if a.kind == "null" else a).col.isNull()
        if a.known_not_null or b.known_not_null:
            return F.lit(False)
        return a.col.isNull() & b.col.isNull()
    if a.kind == "null":
        return F.lit(True)
    if a.kind in ("doc", "array") and a.type != b.type:
        t = common([a.type, b.type])
        return fitted(a, t).eqNullSafe(fitted(b, t))
    x, y = _both(a, b)
    return x.eqNullSafe(y)


def less(a: Val, b: Val, or_equal: bool = False) -> Column:
    """a < b, or a <= b."""
    if EDGES & {a.kind, b.kind}:
        return F.lit(or_equal if a.kind == b.kind else a.kind == "min" or b.kind == "max")
    ra, rb = RANKS[a.kind], RANKS[b.kind]
    if ra != rb:
        low = F.lit(ra < rb)
        if a.kind == "null":
            return b.col.isNotNull() | F.lit(or_equal)
        if b.kind == "null":
            return a.col.isNull() if or_equal else F.lit(False)
        if a.known_not_null and b.known_not_null:
            return low
        tie = F.lit(or_equal)
        return F.when(a.col.isNull(), b.col.isNotNull() | (tie if not b.known_not_null else F.lit(True))).otherwise(b.col.isNotNull() & low)
    if a.kind == "null":
        return F.lit(or_equal)
    x, y = _both(a, b)
    core = x <= y if or_equal else x < y
    if _nan(a) or _nan(b):  # here NaN is the largest number, there the least
        nx, ny = (F.isnan(v.col) if _nan(v) else F.lit(False) for v in (a, b))
        if b.known_not_null:
            core = core | nx
        elif a.known_not_null:
            core = core & ~ny
        else:
            ranked = F.when(nx, F.lit(True) if or_equal else ~ny).when(ny, F.lit(False)).otherwise(core)
            core = F.when(a.col.isNotNull() & b.col.isNotNull(), ranked)
    if b.known_not_null:
        return a.col.isNull() | core
    if a.known_not_null:
        return F.coalesce(core, F.lit(False))
    if or_equal:
        return a.col.isNull() | F.coalesce(core, F.lit(False))
    return (a.col.isNull() & b.col.isNotNull()) | F.coalesce(core, F.lit(False))


def more(a: Val, b: Val, or_equal: bool = False) -> Column:
    """a > b, or a >= b."""
    if EDGES & {a.kind, b.kind}:
        return less(b, a, or_equal)
    if b.known_not_null and RANKS[a.kind] == RANKS[b.kind] and a.kind != "null":
        x, y = _both(a, b)
        core = x >= y if or_equal else x > y
        return core & ~F.isnan(a.col) if _nan(a) else core  # null stays null, which no filter keeps
    return less(b, a, or_equal)


def sort_keys(v: Val, descending: bool) -> list[Column]:
    """Columns that sort as the total order does."""
    cols = []
    if v.kind == "double":
        low = F.when(F.isnan(v.col), F.lit(0)).when(v.col.isNotNull(), F.lit(1))
        cols.append(low)
    cols.append(v.col)
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in cols]
