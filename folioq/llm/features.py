"""Hashed text features, made by array operations over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes by class, for word shapes: 1 digit, 2 lower case or beyond ASCII, 3 upper case, 4 other signs.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91], _CLASS[128:] = 1, 2, 3, 2
#: Bytes that are hashed together; longer texts go by parts that end between words. A run of more bytes without a blank counts as words of
#: this length and a rest, from its start on, so that memory stays bounded; nothing of it is left out.
PART = 1 << 18
_BLANKS = tuple(bytes([c]) for c in np.flatnonzero(_BLANK))
#: Words of more bytes than this also count by the pieces inside them: in scripts without blanks a whole line is one word.
LONG = 24
_R = 0x9E3779B97F4A7C15 | 1
_ROOT = pow(_R, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(r: int) -> np.ndarray:
        out = np.full(n, r, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return up(_R), up(_ROOT)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0xD6E8FEB86659FD93 % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Features:
    """bits: weights are 2**bits. Whole words, their first `prefix` bytes, their shapes and last two bytes' classes, whether a word
    repeats the one before it, and in words of more than LONG bytes the pieces of `grams` bytes that start at each character, are hashed
    together; a text's counts are damped by log(1 + n) and scaled to length 1."""

    bits: int = 16
    words: bool = True
    grams: int = 6
    prefixes: tuple[int, ...] = (4, 6)
    shapes: bool = True
    repeats: bool = True

    def each(self, texts: list[str | None], make: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
        """make(row, feature, value, number of texts) over a few texts at a time, and its results one below the other: what is held
        at once follows PART and the longest text, not the number of texts."""
        out, first, size = [], 0, 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= PART or k == len(texts) - 1:
                out.append(make(*self.rows(texts[first : k + 1]), k + 1 - first))
                first, size = k + 1, 0
        return np.concatenate(out) if out else make(*self.rows([]), 0)

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) of the texts, by row, then feature. Texts without words have none."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        batch: list[bytes] = []
        first, size = 0, 0
        for k, t in enumerate(texts):
            raw = (t or "").encode()
            if size and size + len(raw) > PART:
                found.append(self._counted(batch, first))
                batch, first, size = [], k, 0
            batch.append(raw)
            size += len(raw) + 1
        if batch:
            found.append(self._counted(batch, first))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, feature, count = (np.concatenate(x) for x in zip(*found))
        value = np.log1p(count)
        norm = np.sqrt(np.bincount(row, value * value, len(texts)))
        return row, feature, value / norm[row]

    def _counted(self, raws: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, counts = [], []
        if len(raws) == 1 and len(raws[0]) > PART:
            raw, at, last = raws[0], 0, None
            while at < len(raw):
                if _BLANK[raw[at]]:  # a part starts with a word
                    at += 1
                    continue
                to = at + PART
                if to < len(raw) and (cut := max(raw.rfind(b, at, to) for b in _BLANKS)) > at:
                    to = cut
                key, last = self._hashed(raw[at:to] + b"\n", np.array([0]), last)
                keys.append(key)
                at = to
        if not keys:
            starts = np.cumsum([0, *(len(r) + 1 for r in raws[:-1])])
            keys.append(self._hashed(b"\n".join(raws) + b"\n", starts)[0])
        for i, k in enumerate(keys):
            keys[i], n = np.unique(k, return_counts=True)
            counts.append(n)
        if len(keys) > 1:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        else:
            key, count = keys[0], counts[0]
        return (key >> self.bits) + first, key & ((1 << self.bits) - 1), count

    def _hashed(self, raw: bytes, starts: np.ndarray, last: np.uint64 | None = None) -> tuple[np.ndarray, np.uint64 | None]:
        """row << bits | feature for each occurrence, and the last word's hash. starts: where each text begins; last: the hash of the word
        before the first one."""
        b = np.frombuffer(raw, np.uint8)
        blank = _BLANK[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        if not len(s):
            return np.zeros(0, np.int64), last
        row = np.searchsorted(starts, s, "right") - 1
        up, down = _powers(1 << max(18, len(b).bit_length()))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[b].astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
        piece = lambda a, z: (upto[z] - upto[a]) * down[a]
        word = piece(s, e)
        kinds = []
        if self.words:
            kinds.append(_mix(word, 1))
        for n in self.prefixes:
            kinds.append(_mix(piece(s, np.minimum(s + n, e)), 10 + n))
        if self.shapes:
            c = _CLASS[b].astype(np.uint64)
            length = np.minimum(e - s, 12).astype(np.uint64)
            end, before, head = c[e - 1], c[np.maximum(e - 2, s)], c[s]
            kinds.append(_mix(((head * np.uint64(8) + before) * np.uint64(8) + end), 2))
            kinds.append(_mix(((before * np.uint64(8) + end) * np.uint64(16) + length), 3))
        if self.repeats:
            same = np.zeros(len(s), np.uint64)
            same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
            same[0] = last is not None and word[0] == last
            kinds.append(_mix(same, 4))
        mask = np.uint64((1 << self.bits) - 1)
        out = [(row << self.bits) | (k & mask).astype(np.int64) for k in kinds]
        if self.grams and (e - s > LONG).any():
            step = np.zeros(len(b) + 1, np.int8)
            step[s[e - s > LONG]] = 1
            step[e[e - s > LONG]] = -1
            at = np.flatnonzero((np.cumsum(step[:-1]) > 0) & (b & 0xC0 != 0x80))
            of = np.searchsorted(s, at, "right") - 1
            at, of = (x[at + self.grams <= e[of]] for x in (at, of))
            out.append((row[of] << self.bits) | (_mix(piece(at, at + self.grams), 5) & mask).astype(np.int64))
        return np.concatenate(out), word[-1]


def dot(row: np.ndarray, feature: np.ndarray, value: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Each row's sum of value * weight."""
    return np.bincount(row, value * weights[feature], n)
