"""Nodes of the expression language, and their canonical text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


def _nodes(x: Any) -> Iterator[Node]:
    if isinstance(x, Node):
        yield x
    elif isinstance(x, tuple):
        for y in x:
            yield from _nodes(y)


@dataclass(frozen=True)
class Lit(Node):
    """kind: int, long, double, string, bool or null."""

    value: Any
    kind: str

    def __str__(self) -> str:
        return json.dumps(self.value, ensure_ascii=False)


@dataclass(frozen=True)
class Param(Node):
    name: str

    def __str__(self) -> str:
        return f"@{self.name}"


@dataclass(frozen=True)
class Step(Node):
    pass


@dataclass(frozen=True)
class Get(Step):
    name: str

    def __str__(self) -> str:
        return f".{self.name}" if self.name.isidentifier() else f".[{json.dumps(self.name)}]"


@dataclass(frozen=True)
class At(Step):
    index: Node

    def __str__(self) -> str:
        return f"[{self.index}]"


@dataclass(frozen=True)
class Every(Step):
    def __str__(self) -> str:
        return "[*]"


@dataclass(frozen=True)
class Such(Step):
    test: Node

    def __str__(self) -> str:
        return f"[{self.test}]"


@dataclass(frozen=True)
class Path(Node):
    root: str  # $ or @
    steps: tuple[Step, ...] = ()

    def __str__(self) -> str:
        return self.root + "".join(map(str, self.steps))


@dataclass(frozen=True)
class Source(Node):
    """All documents of the source."""

    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Doc(Node):
    items: tuple[tuple[str, Node], ...]

    def __str__(self) -> str:
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in self.items) + "}"


@dataclass(frozen=True)
class Arr(Node):
    items: tuple[Node, ...]

    def __str__(self) -> str:
        return "[" + ",".join(map(str, self.items)) + "]"


@dataclass(frozen=True)
class Paren(Node):
    inner: Node

    def __str__(self) -> str:
        return f"({self.inner})"


@dataclass(frozen=True)
class Op(Node):
    """quantifier: '', ANY or ALL."""

    name: str
    left: Node
    right: Node
    quantifier: str = ""

    def __str__(self) -> str:
        word = f" {self.quantifier} {self.name} " if self.quantifier else f" {self.name} " if self.name.isalpha() or "_" in self.name else self.name
        return f"{self.left}{word}{self.right}"


@dataclass(frozen=True)
class Range(Node):
    """The right side of BETWEEN."""

    low: Node
    high: Node

    def __str__(self) -> str:
        return f"{self.low} AND {self.high}"


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]

    def __str__(self) -> str:
        return f"{self.name}({','.join(map(str, self.args))})"


@dataclass(frozen=True)
class Each(Node):
    """MAP, FILTER or SORT with a lambda."""

    name: str
    over: Node
    body: Node
    extra: tuple[Node, ...] = ()

    def __str__(self) -> str:
        return f"{self.name}({self.over}=>{self.body}{''.join(f',{e}' for e in self.extra)})"


def root_fields(node: Node) -> list[str]:
    """Fields of the document that the expression names, in order, once each."""
    names: dict[str, str] = {}
    for n in node.walk():
        if isinstance(n, Path) and n.root == "$" and n.steps and isinstance(n.steps[0], Get):
            names.setdefault(n.steps[0].name.lower(), n.steps[0].name)
    return list(names.values())


def default_name(node: Node) -> str:
    return "_".join(root_fields(node)) or "expr"


def has_source(node: Node) -> bool:
    return any(isinstance(n, Source) for n in node.walk())
