"""Hashed character n-grams of Arrow text columns.

Texts are lower-cased and taken as code points. A long text is cut into parts that overlap by less than the longest
n-gram and count each n-gram once, so memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LIMIT = 1 << 18
BLANK = 32
_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


@dataclass
class Grams:
    """Code points of some texts: the ``row`` each belongs to, where its text ``ends`` and where this block's own part of it does (``own``)."""

    codes: np.ndarray
    row: np.ndarray
    ends: np.ndarray
    own: np.ndarray

    def buckets(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash buckets of all n-grams of one length, the first ``bits`` of their hashes, and their rows."""
        h, row = self.hashes(n)
        return h >> np.uint32(32 - bits), row

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """32-bit hashes of all n-grams of one length and their rows."""
        count = len(self.codes) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        h = np.full(count, n, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) + self.codes[j : j + count]
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        at = np.arange(count)
        valid = (at + n <= self.ends[:count]) & (at < self.own[:count])
        return h[valid], self.row[:count][valid]


def letters_only(text: str) -> str:
    """Letters, with one blank for every run of anything else, and a blank at both ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letter = np.ones(len(codes), bool)
    low = codes < len(_LETTER)
    letter[low] = _LETTER[codes[low]]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, np.uint32(BLANK))[keep]
    return f" {codes.tobytes().decode('utf-32-le')} "


def blocks(column: pa.Array, longest: int, prepare=None) -> Iterator[Grams]:
    """The column's texts (null: empty) in blocks of about LIMIT characters, for n-grams of at most ``longest``."""
    parts: list[tuple[int, str, int]] = []
    size = 0
    for row, text in enumerate(column.to_pylist()):
        if not text:
            continue
        text = text.lower()
        if prepare:
            text = prepare(text)
        for at in range(0, len(text), LIMIT):
            part = text[at : at + LIMIT + longest - 1]
            if size and size + len(part) > LIMIT:
                yield _grams(parts)
                parts, size = [], 0
            parts.append((row, part, min(LIMIT, len(text) - at)))
            size += len(part)
    if parts:
        yield _grams(parts)


def _grams(parts: list[tuple[int, str, int]]) -> Grams:
    codes = np.frombuffer("".join(p for _, p, _ in parts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(p) for _, p, _ in parts])
    upto = np.cumsum(lengths)
    own = upto - lengths + np.array([n for _, _, n in parts])
    spread = lambda x: np.repeat(np.asarray(x, np.int64), lengths)
    return Grams(codes, spread([r for r, _, _ in parts]), spread(upto), spread(own))
