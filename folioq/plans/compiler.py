"""From nodes to typed Columns."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindFault
from ..functions import library as lib
from ..functions import operators as ops
from ..functions import values as V
from ..functions.values import Val
from .ast import Arr, At, Call, Doc, Each, Every, Get, Lit, Node, Op, Param, Paren, Path, Range, Source, Such, has_source

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "FIRST", "LAST", "ANY")


@contextmanager
def dialect(spark: SparkSession):
    """Plans that are made inside wrap whole numbers and count time in UTC, whatever the session says."""
    want = {"spark.sql.ansi.enabled": "false", "spark.sql.session.timeZone": "UTC"}
    had = {k: spark.conf.get(k) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)


def row_of(df: DataFrame) -> Val:
    """The current document: its fields are the table's columns."""
    quoted = lambda n: F.col(f"`{n.replace('`', '``')}`")
    return Val(F.struct(*[quoted(f.name) for f in df.schema.fields]), df.schema, fields=quoted)


@dataclass(frozen=True)
class Rows:
    """Values over all rows of the source, before any is aggregated."""

    value: Val
    where: Column | None = None
    distinct: bool = False


@dataclass
class Aggregates:
    """Collects what must be aggregated, once each; `order` is what FIRST, LAST and lists go by."""

    row: Val
    order: list[Column]
    made: dict[str, tuple[str, Column]] = field(default_factory=dict)

    def add(self, text: str, col: Column) -> Column:
        name = self.made.setdefault(text, (f"__agg{len(self.made)}", col))[0]
        return F.col(name)

    @property
    def columns(self) -> list[Column]:
        return [c.alias(n) for n, c in self.made.values()]


@dataclass(frozen=True)
class Scope:
    """What names stand for. root: `$`, or None where there is no current document; current: `@`; aggregates: set where `*` is the source."""

    root: Val | None
    params: dict[str, Any] = field(default_factory=dict)
    current: Val | None = None
    aggregates: Aggregates | None = None
    bound: dict[str, Val] = field(default_factory=dict)


def compile_node(n: Node, scope: Scope) -> Val:
    made = _compile(n, scope)
    return _listed(n, made, scope) if isinstance(made, Rows) else made


def _listed(n: Node, rows: Rows, scope: Scope) -> Val:
    """Rows as a sequence in source order; only where no aggregate function takes them."""
    agg = scope.aggregates
    pair = F.struct(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(agg.order)]).alias("k"), rows.value.col.alias("v"))
    got = F.collect_list(F.when(rows.where, pair) if rows.where is not None else pair)
    col = F.transform(F.array_sort(agg.add(f"list {n}", got)), lambda x: x.getField("v"))
    t = T.ArrayType(rows.value.type)
    return Val(F.array_distinct(col) if rows.distinct else col, t, True)


def _compile(n: Node, s: Scope) -> Val | Rows:
    if isinstance(n, Lit):
        if n.kind == "long":
            return Val(F.lit(n.value).cast("long"), T.LongType(), literal=(n.value,))
        return V.lit(n.value)
    if isinstance(n, Paren):
        return _compile(n.inner, s)
    if isinstance(n, Param):
        low = n.name.lower()
        if low in s.bound:
            return s.bound[low]
        return V.lit(next((v for k, v in s.params.items() if k.lower() == low), None))
    if isinstance(n, Source):
        if not s.aggregates:
            raise BindFault("* has no source here")
        return Rows(s.aggregates.row)
    if isinstance(n, Path):
        return _path(n, s)
    if isinstance(n, Doc):
        return _document(n, s)
    if isinstance(n, Arr):
        return V.array([_plain(compile_node(x, s)) for x in n.items], literal=_constant_list(n, s))
    if isinstance(n, Op):
        return _operator(n, s)
    if isinstance(n, Each):
        return _each(n, s)
    if isinstance(n, Call):
        return _call(n, s)
    raise BindFault(f"cannot compile {n}")


def _plain(v: Val) -> Val:
    return replace(v, seq=False)


def _constant_list(n: Arr, s: Scope) -> tuple:
    vals = [compile_node(x, s) for x in n.items]
    return ([v.literal[0] for v in vals],) if vals and all(v.literal for v in vals) else ()


#: A document of one such key with a text is a value of that type.
TYPED_KEYS = {"$oid": "OBJECTID", "$date": "DATETIME", "$guid": "GUID", "$binary": "BINARY", "$numberLong": "LONG", "$numberDecimal": "DECIMAL"}


def _document(n: Doc, s: Scope) -> Val:
    if len(n.items) == 1 and n.items[0][0] in TYPED_KEYS and isinstance(n.items[0][1], Lit) and n.items[0][1].kind == "string":
        return lib.call(TYPED_KEYS[n.items[0][0]], [V.lit(n.items[0][1].value)])
    return V.doc({k: _plain(compile_node(v, s)) for k, v in n.items})


def _path(n: Path, s: Scope) -> Val | Rows:
    here = s.root if n.root == "$" else s.current if s.current is not None else s.root
    if here is None:
        name = next((x.name for x in n.steps if isinstance(x, Get)), "$")
        raise BindFault(f"{name} has no value here: a group has its key, and aggregates over *")
    for step in n.steps:
        if isinstance(step, Get):
            here = V.field(here, step.name)
        elif isinstance(step, Every):
            here = lib.listed(here) if here.kind == "array" or isinstance(here.type, V.JsonText) else Val(F.array().cast(T.ArrayType(here.type)), T.ArrayType(here.type), True)
        elif isinstance(step, Such):
            here = _such(lib.listed(here), step.test, s)
        elif isinstance(step, At):
            if isinstance(here.type, V.JsonText):
                here = Val(V.json_items(here.col), T.ArrayType(V.JsonText()))
            if here.kind != "array":
                here = V.null()
                continue
            at = compile_node(step.index, s)
            if at.literal and isinstance(at.literal[0], int):
                k = at.literal[0]
                here = Val(F.get(here.col, F.lit(k) if k >= 0 else F.size(here.col) + k), here.element)
            else:
                pos = at.col.cast("int")
                here = Val(F.get(here.col, F.when(pos >= 0, pos).otherwise(F.size(here.col) + pos)), here.element)
    return here


def _such(items: Val, test: Node, s: Scope) -> Val:
    return Val(F.filter(items.col, _with_element(items.element, lambda v: _test(test, replace(s, current=v)))), items.type, True)


def _with_element(t: T.DataType, make: Callable[[Val], Column]) -> Callable[[Column], Column]:
    def body(x: Column) -> Column:
        return make(Val(x, t))

    return body


def _test(n: Node, s: Scope) -> Column:
    v = compile_node(n, s)
    if v.kind != "bool":
        raise BindFault(f"not a predicate: {n}")
    return F.coalesce(v.col, F.lit(False))


def _operator(n: Op, s: Scope) -> Val:
    left = _compile(n.left, s)
    if isinstance(left, Rows):
        left = _listed(n.left, left, s)
    if isinstance(n.right, Range):
        low, high = compile_node(n.right.low, s), compile_node(n.right.high, s)
        make = lambda v: ops.between(v, low, high)
    else:
        right = _plain(compile_node(n.right, s))
        make = lambda v: ops.BINARY[n.name](v, right)
    if not n.quantifier:
        return make(left)
    items = lib.listed(left)
    test = _with_element(items.element, lambda v: F.coalesce(make(v).col, F.lit(False)))
    return Val((F.exists if n.quantifier == "ANY" else F.forall)(items.col, test), lib.BOOL)


def _each(n: Each, s: Scope) -> Val | Rows:
    over = _compile(n.over, s)
    if isinstance(over, Rows):
        inner = replace(s, root=None, current=over.value, aggregates=None)
        if n.name == "MAP":
            value = compile_node(n.body, inner)
            if not value.seq:
                return Rows(value, over.where, over.distinct)
        if n.name == "FILTER":
            test = _test(n.body, inner)
            return Rows(over.value, test if over.where is None else over.where & test, over.distinct)
        over = _listed(n.over, over, s)
    items = lib.listed(over)
    scoped = lambda v: replace(s, current=v)
    if n.name == "FILTER":
        return _such(items, n.body, s)
    probe = compile_node(n.body, scoped(Val(F.lit(None).cast(items.element), items.element)))
    body = _with_element(items.element, lambda v: compile_node(n.body, scoped(v)).col)
    if n.name == "MAP":
        made = F.transform(items.col, body)
        return Val(F.flatten(made), probe.type, True) if probe.seq else Val(made, T.ArrayType(probe.type), True)
    ascending = True
    if n.extra:
        how = compile_node(n.extra[0], s)
        x = lib.constant(how, "a direction")
        ascending = (isinstance(x, int) and not isinstance(x, bool) and x > 0) or (isinstance(x, str) and x.lower() == "asc")
    keyed = F.transform(items.col, lambda x, i: F.struct(body(x).alias("k"), i.alias("i"), x.alias("v")))
    ordered = F.array_sort(keyed, _by_key(ascending))
    return Val(F.transform(ordered, lambda x: x.getField("v")), items.type, True)


def _by_key(ascending: bool) -> Callable[[Column, Column], Column]:
    """Null lowest; equal keys keep their order."""

    def compare(a: Column, b: Column) -> Column:
        x, y = (a, b) if ascending else (b, a)
        k, m = x.getField("k"), y.getField("k")
        below = (k.isNull() & m.isNotNull()) | (k < m)
        above = (k.isNotNull() & m.isNull()) | (k > m)
        return F.when(below, -1).when(above, 1).otherwise(a.getField("i") - b.getField("i"))

    return compare


def _call(n: Call, s: Scope) -> Val | Rows:
    args = [_compile(a, s) for a in n.args]
    if len(args) == 1 and isinstance(args[0], Rows):
        if n.name in AGGREGATES:
            return _aggregate(n, args[0], s)
        if n.name == "DISTINCT":
            return Rows(args[0].value, args[0].where, True)
        if n.name == "ITEMS":
            return args[0]
    vals = [_listed(node, a, s) if isinstance(a, Rows) else a for node, a in zip(n.args, args)]
    if any(v.seq for v in vals) and n.name not in lib.SEQUENCES:
        raise BindFault(f"{n.name} takes one value: use MAP, or wrap the sequence in ARRAY()")
    if n.name == "ARRAY":
        return _plain(lib.call("ARRAY", vals))
    return lib.call(n.name, vals)


def _aggregate(n: Call, rows: Rows, s: Scope) -> Val:
    """A native aggregate: partial results are made where the rows are, and no list is gathered."""
    agg, v = s.aggregates, rows.value
    number = v.kind in V.NUMBERS
    here = (lambda c: c) if rows.where is None else (lambda c: F.when(rows.where, c))
    there = F.lit(1) if rows.where is None else F.when(rows.where, F.lit(1))
    add = lambda kind, col: agg.add(f"{kind} {n}", col)
    if n.name in ("COUNT", "ANY"):
        if rows.distinct:  # null is one value
            nulls = F.coalesce(F.max(here(v.col.isNull().cast("int"))), F.lit(0))
            col = add("count", F.count_distinct(here(v.col)) + nulls)
        else:
            col = add("count", F.count(there))
        return Val(col.cast("long"), T.LongType()) if n.name == "COUNT" else Val(col > 0, lib.BOOL)
    if n.name in ("SUM", "AVG"):
        if not number:
            return V.lit(0)
        f = {"SUM": (F.sum, F.sum_distinct), "AVG": (F.avg, lambda c: F.sum_distinct(c) / F.count_distinct(c))}[n.name][rows.distinct]
        t = T.LongType() if n.name == "SUM" and v.kind in ("int", "long") else T.DoubleType() if v.kind != "decimal" else T.DecimalType(38, 18)
        return Val(F.coalesce(add(n.name, f(here(v.col))), F.lit(0)).cast(t), t)
    if n.name == "MIN":
        lowest = add("min", F.min(here(v.col)))
        any_null = add("null", F.max(here(v.col.isNull().cast("int"))))
        if v.kind == "double":  # NaN is the least number
            any_nan = add("nan", F.max(here(F.isnan(v.col).cast("int"))))
            lowest = F.when(any_nan == 1, F.lit(float("nan"))).otherwise(lowest)
        return Val(F.when(F.coalesce(any_null, F.lit(0)) == 0, lowest), v.type)
    if n.name == "MAX":
        highest = F.max(here(F.when(~F.isnan(v.col), v.col) if v.kind == "double" else v.col))
        if v.kind == "double":
            return Val(F.coalesce(add("max", highest), add("nan", F.max(here(v.col)))), v.type)
        return Val(add("max", highest), v.type)
    key = F.struct(*agg.order)
    pick = F.min_by if n.name == "FIRST" else F.max_by
    return Val(add(n.name, pick(F.struct(v.col.alias("v")), here(key))).getField("v"), v.type)

