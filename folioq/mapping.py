"""Dataclasses as documents."""

from __future__ import annotations

import dataclasses
import types
import typing
from collections.abc import Callable
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession

from .sources.documents import frame_of

C = TypeVar("C")
NAMINGS: dict[str, Callable[[str], str]] = {
    "keep": lambda n: n,
    "lower": str.lower,
    "camel": lambda n: (p := n.split("_"))[0] + "".join(w.capitalize() for w in p[1:]),
}


def option(f: dataclasses.Field, key: str, default: Any = None) -> Any:
    return f.metadata.get(key, default)


class Mapper:
    """Field options, in a field's metadata: name, id (the document's _id), skip, omit_empty, inline (its fields are the document's),
    ref (a collection: the field is kept as a reference), vector (a list of floats). `kinds` are classes that documents name by _type."""

    def __init__(self, naming: str = "keep", kinds: dict[str, type] | None = None) -> None:
        self.naming, self.kinds = NAMINGS[naming], dict(kinds or {})
        self.custom: dict[type, tuple[Callable[[Any], Any], Callable[[Any], Any]]] = {}

    def register(self, kind: type, to: Callable[[Any], Any], back: Callable[[Any], Any]) -> Mapper:
        self.custom[kind] = (to, back)
        return self

    def name(self, f: dataclasses.Field) -> str:
        return "_id" if option(f, "id") else option(f, "name") or self.naming(f.name)

    def to_document(self, x: Any) -> Any:
        if type(x) in self.custom:
            return self.custom[type(x)][0](x)
        if dataclasses.is_dataclass(x):
            out: dict[str, Any] = {}
            label = next((k for k, c in self.kinds.items() if c is type(x)), None)
            if label:
                out["_type"] = label
            for f in dataclasses.fields(x):
                value = getattr(x, f.name)
                if option(f, "skip") or option(f, "omit_empty") and not value:
                    continue
                if option(f, "ref"):
                    key = next((getattr(value, g.name) for g in dataclasses.fields(value) if option(g, "id")), None) if dataclasses.is_dataclass(value) else value
                    out[self.name(f)] = None if key is None else {"$id": key, "$ref": option(f, "ref")}
                elif option(f, "inline") and value is not None:
                    out |= {k: v for k, v in self.to_document(value).items() if k != "_type"}
                else:
                    out[self.name(f)] = [float(v) for v in value] if option(f, "vector") else self.to_document(value)
            return out
        if isinstance(x, dict):
            return {k: self.to_document(v) for k, v in x.items()}
        return [self.to_document(v) for v in x] if isinstance(x, (list, tuple)) else x

    def from_document(self, doc: Any, kind: type[C]) -> C:
        if kind in self.custom:
            return self.custom[kind][1](doc)
        origin = typing.get_origin(kind)
        if origin in (types.UnionType, typing.Union):
            inner = [k for k in typing.get_args(kind) if k is not type(None)]
            return None if doc is None else self.from_document(doc, inner[0])
        if origin in (list, tuple) and doc is not None:
            inner = (typing.get_args(kind) or (Any,))[0]
            return origin(self.from_document(v, inner) for v in doc)
        if not dataclasses.is_dataclass(kind) or doc is None:
            return doc
        doc = doc.asDict() if hasattr(doc, "asDict") else doc
        low = {k.lower(): v for k, v in doc.items()}
        named = self.kinds.get(low.get("_type"), kind)
        kind = named if issubclass(named, kind) else kind
        hints, got = typing.get_type_hints(kind), {}
        for f in dataclasses.fields(kind):
            if option(f, "inline"):
                got[f.name] = self.from_document(doc, hints[f.name])
            elif not option(f, "skip") and self.name(f).lower() in low:
                value = low[self.name(f).lower()]
                if option(f, "ref") and value is not None and not dataclasses.is_dataclass(hints[f.name]):
                    got[f.name] = (value.asDict() if hasattr(value, "asDict") else value)["$id"]
                else:
                    got[f.name] = self.from_document(value, hints[f.name])
        return kind(**got)

    def frame(self, spark: SparkSession, items: list[Any]) -> DataFrame:
        return frame_of(spark, [self.to_document(x) for x in items])
