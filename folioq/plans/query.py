"""The immutable query builder, and its translation into a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import BindFault
from ..functions import values as V
from ..functions.values import Val
from ..operators.include import include
from .ast import Call, Doc, Lit, Node, Op, Paren, Path, default_name, has_source, root_fields
from .compiler import Aggregates, Scope, compile_node, dialect, row_of
from .parser import COMPARISONS, parse


class Source(Protocol):
    """What a query reads: a table with the columns that order it, and the tables that its references name."""

    name: str
    order: tuple[str, ...]

    def frame(self) -> DataFrame: ...

    def lookup(self, name: str) -> DataFrame | None: ...


ROOT = Path("$")


@dataclass(frozen=True)
class Query:
    """Each step gives a new query; `frame` gives the DataFrame. Errors in texts are raised by the step itself."""

    spark: SparkSession
    source: Source | None
    wheres: tuple[Node, ...] = ()
    projection: Node = ROOT
    orders: tuple[tuple[Node, bool], ...] = ()
    group: Node | None = None
    havings: tuple[Node, ...] = ()
    includes: tuple[tuple[str, tuple[str, ...] | None], ...] = ()
    offset: int = 0
    count_limit: int | None = None
    params: dict[str, Any] = field(default_factory=dict)
    into_hook: Callable[[DataFrame, str, str | None], int] | None = None

    # Steps

    def where(self, text: str) -> Query:
        n = parse(text)
        _predicate(n)
        return replace(self, wheres=(*self.wheres, n))

    def param(self, name: str, value: Any) -> Query:
        return replace(self, params={**self.params, name: value})

    def select(self, text: str) -> Query:
        return replace(self, projection=parse(text))

    def order_by(self, text: str, descending: bool = False) -> Query:
        if self.orders:
            raise BindFault("the order is already defined, use then_by")
        return replace(self, orders=((parse(text), descending),))

    def order_by_desc(self, text: str) -> Query:
        return self.order_by(text, True)

    def then_by(self, text: str, descending: bool = False) -> Query:
        if not self.orders:
            raise BindFault("then_by needs order_by before it")
        return replace(self, orders=(*self.orders, (parse(text), descending)))

    def then_by_desc(self, text: str) -> Query:
        return self.then_by(text, True)

    def group_by(self, text: str) -> Query:
        if self.group is not None:
            raise BindFault("group_by is already defined")
        if self.includes:
            raise BindFault("include does not go with group_by")
        return replace(self, group=parse(text))

    def having(self, text: str) -> Query:
        if self.group is None:
            raise BindFault("having needs group_by")
        return replace(self, havings=(*self.havings, parse(text)))

    def include(self, path: str, refs: list[str] | None = None) -> Query:
        n = parse(path)
        names = root_fields(n)
        if self.group is not None:
            raise BindFault("include does not go with group_by")
        if len(names) != 1:
            raise BindFault("include takes one field")
        return replace(self, includes=(*self.includes, (names[0], tuple(refs) if refs else None)))

    def skip(self, n: int) -> Query:
        return replace(self, offset=n)

    def limit(self, n: int) -> Query:
        return replace(self, count_limit=n)

    def for_update(self) -> Query:
        """Snapshots need no lock: reading for update is reading."""
        return self

    # Plans

    def frame(self) -> DataFrame:
        with dialect(self.spark):
            if self.source is None:
                return self._without_source()
            df = self.source.frame()
            if self.group is not None:
                return self._grouped(df)
            df = self._before(df)
            if has_source(self.projection):
                return self._whole(df)
            v = compile_node(self.projection, Scope(row_of(df), self.params))
            return df if self.projection == ROOT else df.select(*columns(v, default_name(self.projection)))

    def _without_source(self) -> DataFrame:
        df = self.spark.range(1)
        v = compile_node(self.projection, Scope(V.doc({}), self.params))
        return df.select(*columns(v, default_name(self.projection)))

    def _filtered(self, df: DataFrame) -> DataFrame:
        for n in self.wheres:
            v = compile_node(n, Scope(row_of(df), self.params))
            if v.kind != "bool":
                raise BindFault(f"not a predicate: {n}")
            df = df.where(v.col)
        return df

    def _before(self, df: DataFrame) -> DataFrame:
        """Filter, sort and page, with references expanded before those that look at them, and after paging otherwise."""
        looked = {f.lower() for n in (*self.wheres, *(n for n, _ in self.orders)) for f in root_fields(n)}
        first = [i for i in self.includes if i[0].lower() in looked]
        for name, refs in first:
            df = include(df, name, self.source.lookup, refs and list(refs))
        df = self._filtered(df)
        paged = self.offset or self.count_limit is not None
        ties = [F.col(f"`{c}`").asc_nulls_first() for c in self.source.order if c in df.columns]
        if self.orders:
            scope = Scope(row_of(df), self.params)
            df = df.orderBy(*[k for n, d in self.orders for k in V.sort_keys(compile_node(n, scope), d)], *ties)
        elif paged:
            df = df.orderBy(*ties)
        df = self._paged(df)
        for name, refs in (i for i in self.includes if i not in first):
            df = include(df, name, self.source.lookup, refs and list(refs))
        return df

    def _paged(self, df: DataFrame) -> DataFrame:
        if self.offset:
            df = df.offset(self.offset)
        return df if self.count_limit is None else df.limit(self.count_limit)

    def _whole(self, df: DataFrame) -> DataFrame:
        """One row for the whole source, which paging has cut already."""
        agg = Aggregates(row_of(df), [F.col(f"`{c}`") for c in self.source.order])
        v = compile_node(self.projection, Scope(None, self.params, aggregates=agg))
        out = columns(v, default_name(self.projection))
        return df.agg(*agg.columns).select(*out) if agg.made else self.spark.range(1).select(*out)

    def _grouped(self, df: DataFrame) -> DataFrame:
        df = self._filtered(df)
        key = compile_node(self.group, Scope(row_of(df), self.params))
        df = df.withColumn("__key", key.col)
        row = row_of(df.drop("__key"))
        agg = Aggregates(row, [F.col(f"`{c}`") for c in self.source.order])
        bound = {"key": Val(F.col("__key"), key.type)}
        scope = Scope(None, self.params, aggregates=agg, bound=bound)
        projection = parse("{key: @key, items: *}") if self.projection == ROOT else self.projection
        out = compile_node(projection, scope)
        if out.kind != "doc":
            out = V.doc({default_name(projection): out})
        tests = [compile_node(n, scope) for n in self.havings]
        keys = [k for n, d in self.orders for k in V.sort_keys(compile_node(n, replace(scope, root=out)), d)]
        made = df.groupBy("__key").agg(*agg.columns) if agg.made else df.select("__key").distinct()
        for t in tests:
            made = made.where(t.col)
        if keys or self.offset or self.count_limit is not None:
            made = self._paged(made.orderBy(*keys, *V.sort_keys(bound["key"], False)))
        return made.select(*columns(out, "expr"))

    # Results

    def slice(self) -> list[Row]:
        return self.frame().collect()

    def all(self):
        """Rows one by one, partition by partition."""
        return self.frame().toLocalIterator()

    def first_or_default(self) -> Row | None:
        return (self if self.count_limit == 0 else self.limit(1)).frame().first()

    def first(self) -> Row:
        row = self.first_or_default()
        if row is None:
            raise BindFault("no document")
        return row

    def single_or_default(self) -> Row | None:
        rows = self.limit(2).frame().take(2)
        if len(rows) > 1:
            raise BindFault("more than one document")
        return rows[0] if rows else None

    def single(self) -> Row:
        row = self.single_or_default()
        if row is None:
            raise BindFault("no document")
        return row

    def count(self) -> int:
        if self.group is None and not has_source(self.projection):
            plain = replace(self, projection=ROOT, orders=(), includes=())
            if not (self.offset or self.count_limit is not None):
                return plain.frame().count()
        return self.frame().count()

    long_count = count

    def exists(self) -> bool:
        return not self.frame().isEmpty()

    def min(self, key: str) -> Any:
        """The least value of the key: the first document's in its order, so null counts."""
        return self._end(key, False)

    def max(self, key: str) -> Any:
        return self._end(key, True)

    def _end(self, key: str, descending: bool) -> Any:
        n = parse(key)
        row = replace(self, orders=((n, descending),), projection=Doc((("v", n),)), count_limit=1).frame().first()
        return row.v if row else None

    def into(self, name: str, auto_id: str | None = None) -> int:
        if not self.into_hook:
            raise BindFault("this source cannot write")
        return self.into_hook(self.frame(), name, auto_id)

    def explain(self) -> dict[str, Any]:
        """The plan as a document, and Spark's own plan under `spark`."""
        name = getattr(self.source, "name", None)
        plan: dict[str, Any] = {
            "collection": name,
            "snaphost": "read",
            "pipe": "groupByPipe" if self.group is not None else "queryPipe",
            "index": self._access(),
            "lookup": {"loader": "document", "fields": sorted({f for n in self._nodes() for f in root_fields(n)}) or "$"},
        }
        if self.wheres:
            plan["filters"] = [str(n) for n in self.wheres]
        if self.orders:
            plan["orderBy"] = [{"expr": str(n), "order": -1 if d else 1} for n, d in self.orders]
        if self.offset:
            plan["offset"] = self.offset
        if self.count_limit is not None:
            plan["limit"] = self.count_limit
        if self.includes:
            plan["includes"] = [n for n, _ in self.includes]
        if self.group is not None:
            plan["groupBy"] = {"expr": str(self.group), "having": [str(n) for n in self.havings], "select": str(self.projection)}
        else:
            plan["select"] = {"expr": str(self.projection), "all": has_source(self.projection)}
        plan["spark"] = self.frame()._jdf.queryExecution().simpleString()
        return plan

    def _access(self) -> dict[str, Any]:
        """How a declared index would be used; Spark filters while it scans, and skips by statistics, either way."""
        best = {"name": "_id", "expr": "$._id", "order": 1, "mode": "FULL INDEX SCAN(_id)", "cost": 100}
        for index, x in {"_id": {"expr": "$._id", "unique": True}, **getattr(self.source, "indexes", {})}.items():
            for n in self.wheres:
                for c in _conjuncts(n):
                    if not isinstance(c, Op) or c.quantifier or str(c.left) != x["expr"]:
                        continue
                    mode, cost = ACCESS.get(c.name, ("", 1000))
                    cost = 1 if c.name == "=" and x["unique"] else cost
                    if cost < best["cost"]:
                        best = {"name": index, "expr": x["expr"], "order": 1, "mode": f"{mode}({index})", "cost": cost}
        return best

    def _nodes(self) -> list[Node]:
        return [*self.wheres, self.projection, *(n for n, _ in self.orders), *self.havings, *([self.group] if self.group is not None else [])]


#: Names and costs of index access by operator.
ACCESS = {"=": ("INDEX SEEK", 10), ">": ("INDEX SCAN", 20), ">=": ("INDEX SCAN", 20), "<": ("INDEX SCAN", 20), "<=": ("INDEX SCAN", 20), "BETWEEN": ("INDEX RANGE SCAN", 20), "IN": ("INDEX SEEK", 10), "LIKE": ("INDEX SCAN", 10), "!=": ("INDEX SCAN", 80)}


def _conjuncts(n: Node) -> list[Node]:
    if isinstance(n, Paren):
        return _conjuncts(n.inner)
    return _conjuncts(n.left) + _conjuncts(n.right) if isinstance(n, Op) and n.name == "AND" else [n]


def _predicate(n: Node) -> None:
    """A condition must be a comparison, or AND/OR of such; `*` has no place in one."""
    bare = n.inner if isinstance(n, Paren) else n
    if has_source(n):
        raise BindFault("* cannot stand in a condition")
    if isinstance(bare, Op) and bare.name in (*COMPARISONS, "AND", "OR"):
        return
    if isinstance(bare, Call) and (bare.name.startswith("IS_") or bare.name == "ANY"):
        return
    if isinstance(bare, Lit) and bare.kind == "bool":
        return
    raise BindFault(f"not a predicate: {n}")


def columns(v: Val, name: str) -> list[Column]:
    """A document's fields as columns, or one column of that name. What is null by type is text, which every sink can hold."""
    if v.kind == "doc" and hasattr(v.type, "fields") and v.type.fields:
        return [_stored(V.field(v, f.name)).alias(f.name) for f in v.type.fields]
    return [_stored(v).alias(name)]


def _stored(v: Val) -> Column:
    return v.col.cast("string") if v.kind == "null" else v.col
