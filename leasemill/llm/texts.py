"""Vectorised views of Arrow text columns: words with 64-bit hashes, shingles, code points.

Everything works on a block of whole texts at a time. Blocks hold about ``BLOCK_BYTES`` of text and ``BLOCK_TEXTS`` texts at most, or one
text where a single one is longer, so memory follows the longest text and not the batch. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
BLOCK_TEXTS = 2048
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_VALUES = _BYTE_VALUES[_LOWER]

#: Bytes of [^\x20\x09-\x0D]+.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALPHANUMERIC = np.ones(256, bool)
ALPHANUMERIC[0x00:0x30] = False
ALPHANUMERIC[0x3A:0x61] = False
ALPHANUMERIC[0x7B:0x80] = False
ALPHANUMERIC[65:91] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept while texts stay below a few blocks."""
    kept = _tables.get(base)
    if kept is None or len(kept) < n:
        kept = _powers(base, max(n, BLOCK_BYTES + 1))
        if n <= 4 * BLOCK_BYTES:
            _tables[base] = kept
    return kept[:n]


@dataclass
class Block:
    """Whole texts ``first .. first + len(bounds) - 2`` of a column; text i is ``data[bounds[i]:bounds[i + 1]]``."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The UTF-8 bytes of a text column, in blocks of whole texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        to = min(to, at + BLOCK_TEXTS)
        yield Block(at, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to


@dataclass
class Words:
    """Word places of a block: byte ``start`` and ``end``, the ``text`` each is in, and ``first`` word of each text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray


def words(block: Block, kind: np.ndarray) -> Words:
    """Runs of bytes of a kind; a word never crosses into the next text."""
    inside = kind[block.data]
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(block) + 1, np.int64))
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    inner = block.bounds[:-1]
    inner = inner[inner < n]
    before[inner] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = block.bounds[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, block.bounds)
    return Words(start, end, np.repeat(np.arange(len(block)), np.diff(first)), first)


def word_hashes(block: Block, places: Words) -> np.ndarray:
    """A 64-bit hash of each word's lower-cased (A-Z) bytes, the same wherever the word stands."""
    n = len(block.data)
    summed = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[block.data] * powers(BASE, n), out=summed[1:])
    value = (summed[places.end] - summed[places.start]) * powers(INVERSE, n + 1)[places.start]
    return mix(value ^ (places.end - places.start).astype(np.uint64))


def shingle_sets(block: Block, places: Words, hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``width``-word shingles; fewer words make one shingle, none make none."""
    step = np.uint64(0xD6E8FEB86659FD93)
    run = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for j in range(width):
        run = run * step + hashes[j : j + len(run)]
    run = mix(run ^ np.uint64(width))
    out = []
    for a, b in zip(places.first[:-1].tolist(), places.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            value = np.zeros(1, np.uint64)
            for h in hashes[a:b]:
                value = value * step + h
            out.append(mix(value ^ np.uint64(b - a)))
        else:
            out.append(run[:0])
    return out
