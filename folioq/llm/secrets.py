"""Secrets: a keyword automaton, anchored patterns only where it hits, then checksums that tokens carry."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = ("assign", "access", "hex")
Span = tuple[str, int, int]

# Keywords (in lower case) with the kind they announce, and what must stand at a hit.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
PATTERNS = {
    "assign": re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
}
HEX = re.compile(rb"[0-9a-f]{32,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum(body: bytes) -> bytes:
    """CRC-32 of the body in base 62, six digits: what such tokens end with."""
    crc, out = zlib.crc32(body), ""
    while crc:
        crc, d = divmod(crc, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0").encode()


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    body = m[0][4:]
    return checksum(body[:-6]) == body[-6:]


def find_secrets(text: str | None) -> list[Span]:
    """Spans in code points, by start, then kind. Each kind's matches are leftmost and don't overlap; failing ones are dropped."""
    raw = (text or "").encode()
    out = [("hex", *m.span()) for m in HEX.finditer(raw)]
    done = dict.fromkeys(KINDS, 0)
    # One character for each byte, so that hits are byte offsets; lower() of bytes changes A-Z only.
    for last, (kind, length) in automaton().iter(raw.lower().decode("latin-1")):
        start = last - length + 1
        if start >= done[kind] and (m := PATTERNS[kind].match(raw, start)):
            done[kind] = m.end()
            if _valid(kind, m):
                out.append((kind, *m.span()))
    if out and len(raw) > len(text):
        at = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        out = [(k, int(at[s]), int(at[e])) for k, s, e in out]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secret_spans(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, a row for each row of `docs`.

    A null text counts as empty and has no spans. Ids may be null or repeated; every row is answered by itself, so ties and repeated
    rows need no rule. Long texts are scanned in linear time. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
        for b in batches:
            rows = []
            for t in b.column(1):
                spans = find_secrets(t.as_py())
                base = [s for s in spans if s[0] in BASE]
                counts = [sum(s[0] == k for s in base) for k in BASE]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    src = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return src.mapInArrow(run, schema)
