"""Personal data: detection that sees through disguises and reports spans of the original text.

Texts pass through transducers: homoglyphs become ASCII, spelled digits become digits, at/dot disguises become @
and full stops. Each keeps where every stretch of its output came from, so identifiers found in the normalised text are
mapped back to the characters of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, rows_in_arrow

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# What counts as an identifier.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_UNSIGNED = bytes(set(range(256)) - set(b"0123456789@+"))
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Characters of other scripts that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "。": ".", "﹫": "@", "﹒": ".",
}
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

#: By rule: full-width forms of ASCII, and every script's decimal digits.
_LOOKALIKE = HOMOGLYPHS | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_LOOKALIKE |= {c: str(d) for c in map(chr, range(0x80, 0x20000)) if (d := unicodedata.decimal(c, None)) is not None}
_MAP = str.maketrans(_LOOKALIKE)
_HOMO = re.compile("[" + "".join(re.escape(c) for c in sorted(_LOOKALIKE)) + "]+")
_HIDDEN = re.compile("[​-‍⁠﻿­]+")
_DIGIT = "(?:" + "|".join(DIGIT_WORDS) + ")"
_GAP = r"(?:\.?[ ,-]{1,3}|\.)"
#: A whole run of digit words. Its first word alone is a match, so a run is read once and never tried again from its middle.
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[ ,-]{{1,3}})?{_DIGIT}(?:{_GAP}(?:{_DIGIT}|dot))*(?![A-Za-z])", re.I | re.A)
_SPELLED_WORD = re.compile(rf"{_DIGIT}|dot|plus|\.(?![ ,-])", re.I | re.A)
#: Digit words in a run that make it a number.
LEAST_SPELLED = 3
#: Quick looks at the lower-case bytes: is there any disguise to undo? A run of three digit words has one with a gap and a further word after it.
_SPOKEN_DIGITS = re.compile(rf"{_DIGIT}{_GAP}(?:{_DIGIT}|dot)".encode())
_LONG_NUMBER = re.compile(r"(?<![0-9+.])[0-9]{10,15}(?![0-9.])")
_BRACKETED = re.compile(rb"[\[({<]\s{0,3}(?:at|dot|@|\.)\s{0,3}[\])}>]|[-_*](?:at|dot)[-_*]|&#64;|&commat;|%40")
#: Of blanks and letters beyond ASCII any byte will do.
_PLAIN_AT = re.compile(rb"at[\s\x1c-\x1f\x80-\xff]{1,9}[a-z0-9\x80-\xff-]{1,189}\.[a-z0-9]")
_SPOKEN_DOT = re.compile(rb"\sdot\s")
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_AT = re.compile(rf"(?<=[A-Za-z0-9])(?:{_OPEN}(?:at|@){_CLOSE}|&#64;|&commat;|%40|\s?[-_*]at[-_*]\s?(?=[A-Za-z0-9-]{{1,63}}\s?[-_*]dot[-_*]))(?=[A-Za-z0-9])", re.I)
_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:{_OPEN}(?:dot|\.){_CLOSE}|\s?[-_*]dot[-_*]\s?)(?=[A-Za-z0-9])", re.I)
# Words that end no local part when "at" follows.
PLAIN_WORDS = "is are was were be look looks meet him her them us it not here there only just or and the stop start end".split()
_NOT_PLAIN = "".join(rf"(?<!\b{w})" for w in PLAIN_WORDS)
_SAID = re.compile(rf"(?<=[A-Za-z0-9]){_NOT_PLAIN}" + r"\s{1,3}at\s{1,3}(?=[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,4}\s{1,3}dot\s{1,3}[A-Za-z])", re.I)
_SAID_DOT = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}dot\s{1,3}(?=[A-Za-z])", re.I)
#: A plain "at" before a plain domain, if the word before it looks like a local part (see _clear_local).
_NAMED = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}at\s{1,3}(?=(?:[A-Za-z0-9-]{1,63}\.){1,5}(?:[A-Za-z]{2,63}|xn--[A-Za-z0-9-]{1,59})(?![A-Za-z0-9]))", re.I)
# Numbers, ordinals and times of day are no local parts when a plain "at" follows.
_PLAIN_NUMBER = re.compile(r"[0-9]+(?:[.,][0-9]+)?(?:am|pm|st|nd|rd|th)?", re.I)
_SPACED = re.compile(r"(?<=[A-Za-z0-9])(?:\s{1,3}@\s{0,3}|@\s{1,3})(?=[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4})")


class Transduced:
    """A text and where it came from: stretches (new start, old start, new length, old length)."""

    def __init__(self, text: str) -> None:
        self.text, self.steps = text, []
        #: Long spelled numbers, by source characters: later steps move the text, not these.
        self.spoken: list[Span] = []

    def apply(self, pattern: re.Pattern, put: Callable[[str], str], only: Callable[[re.Match], bool] = bool) -> None:
        """Replace the pattern's matches, or those that `only` takes. Replacements of equal length keep the place of each character."""
        out, new, old, starts, stretches = [], 0, 0, [], []

        def add(piece: str, length: int) -> None:
            nonlocal new, old
            if length:
                starts.append(new)
                stretches.append((new, old, len(piece), length))
                out.append(piece)
            new, old = new + len(piece), old + length

        for m in filter(only, pattern.finditer(self.text)):
            add(self.text[old : m.start()], m.start() - old)
            add(put(m[0]), m.end() - m.start())
        if stretches:
            add(self.text[old:], len(self.text) - old)
            self.text = "".join(out)
            self.steps.append((starts, stretches))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source characters that text[start:end] stands for; start < end."""
        for starts, stretches in reversed(self.steps):
            n, o, a, b = stretches[bisect_right(starts, start) - 1]
            first = o + (start - n if a == b else 0)
            n, o, a, b = stretches[bisect_right(starts, end - 1) - 1]
            start, end = first, o + (end - n if a == b else b)
        return start, end


def luhn(digits: str) -> bool:
    odd, even = map(int, digits[-1::-2]), map(int, digits[-2::-2])
    return (sum(odd) + sum(d * 2 - 9 * (d > 4) for d in even)) % 10 == 0


def identifiers(text: str) -> list[Span]:
    """Spans by kind, then start. Each kind's matches are leftmost and don't overlap; failing ones are dropped."""
    out: list[Span] = []
    signs = text.encode().translate(None, _UNSIGNED)  # quick: most texts have none of what identifiers need
    if not signs:
        return out
    at, done = text.find("@"), 0
    while at >= 0:  # from each @ outwards: no retry at every character before it
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    digits = len(signs) - signs.count(b"@") - signs.count(b"+")
    for m in IP.finditer(text) if digits >= 4 and "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text) if digits >= 16 else ():
        if m.end() - m.start() >= 16:
            number = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(number) <= 19 and luhn(number):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _spoken(run: str) -> str:
    words = [w.lower() for w in _SPELLED_WORD.findall(run)]
    return "".join({"dot": ".", ".": ".", "plus": "+"}.get(w) or DIGIT_WORDS[w] for w in words)


def _is_number(m: re.Match) -> bool:
    return sum(w.lower() in DIGIT_WORDS for w in _SPELLED_WORD.findall(m[0])) >= LEAST_SPELLED


def _clear_local(m: re.Match) -> bool:
    """True if the word before the match has a digit, _, + or a full stop inside, as local parts have and plain words don't."""
    start = m.start()
    while start and m.string[start - 1] in LOCAL_CHARS:
        start -= 1
    word = m.string[start : m.start()].lstrip(".%-")
    return any(c in "0123456789._+" for c in word) and not _PLAIN_NUMBER.fullmatch(word)


def _western(text: str) -> bool:
    """True if there is nothing but Latin-1 in the text, and no soft hyphen: then there is no lookalike to map."""
    try:
        return b"\xad" not in text.encode("latin-1")
    except UnicodeEncodeError:
        return False


def normalised(text: str) -> Transduced:
    t = Transduced(text)
    if not _western(text):
        t.apply(_HIDDEN, lambda _: "")
        t.apply(_HOMO, lambda run: run.translate(_MAP))
    low = t.text.encode().lower()
    if _SPOKEN_DIGITS.search(low):
        before = len(t.steps)
        t.apply(_SPELLED, _spoken, _is_number)
        if len(t.steps) > before:
            found = ((m, t.source(*m.span())) for m in _LONG_NUMBER.finditer(t.text))
            t.spoken = [("phone", *at) for m, at in found if at[1] - at[0] >= 4 * len(m[0])]
        low = t.text.encode().lower()
    spoken = b"dot" in low and _SPOKEN_DOT.search(low)
    spaced = b"@" in low and (b" @" in low or b"@ " in low)
    opened = any(c in low for c in (b"[", b"(", b"{", b"<", b"&#64;", b"&commat;", b"%40", b"at-", b"at_", b"at*"))
    named = _PLAIN_AT.search(low)
    if spoken or spaced or named or opened and _BRACKETED.search(low):
        t.apply(_AT, lambda _: "@")
        t.apply(_DOT, lambda _: ".")
        t.apply(_SPACED, lambda _: "@")
        t.apply(_NAMED, lambda _: "@", _clear_local)
        if spoken:
            t.apply(_SAID, lambda _: "@")
            if "@" in t.text:
                t.apply(_SAID_DOT, lambda _: ".")
    return t


def find_pii(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, as they stand in the text, and spans that only the normalised text shows; both by kind, then start."""
    text = text or ""
    base = identifiers(text)
    t = normalised(text)
    if not t.steps:
        return base, []
    ends = {k: {s: e for kind, s, e in base if kind == k} for k in KINDS}  # by kind base spans come by start and don't overlap
    starts = {k: list(v) for k, v in ends.items()}
    more = []
    for kind, start, end in [(k, *t.source(s, e)) for k, s, e in identifiers(t.text)] + t.spoken:
        at = bisect_right(starts[kind], start)
        if not at or end > ends[kind][starts[kind][at - 1]]:  # what reaches beyond a base span is told too
            more.append((kind, start, end))
    return base, more


def order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str | None) -> str | None:
    """The text with each found span (overlapping ones as one) replaced by its kind in brackets."""
    base, more = find_pii(text)
    if not base and not more:
        return text
    out, at = [], 0
    for kind, start, end in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256 and spans, a row for each row of `docs`.

    A null text counts as empty and has no spans. Ids may be null or repeated; every row is answered by itself, so ties and repeated
    rows need no rule. Long texts are scanned in linear time. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        for b in batches:
            rows = []
            for t in b.column(1):
                base, more = find_pii(t.as_py())
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(order(base + more))))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    src = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return src.mapInArrow(run, schema)


def masked_documents(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """`docs` with personal data masked in `text`; all other columns, whatever their names, and all rows as they are.

    Null texts stay null, empty ones empty; repeated rows are masked alike; an empty table gives no rows.
    """
    at = docs.columns.index(text)
    return rows_in_arrow(docs, lambda b: b.set_column(at, "text", pa.array([masked(t.as_py()) for t in b.column(at)], pa.string())))
