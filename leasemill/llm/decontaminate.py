"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions and answers.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ``width`` consecutive words of
an item; an item of fewer words, but not none, is one window. The automaton holds every window as its words between
single blanks, so one scan of a text's words finds all places of all windows. Places are mapped back to word numbers
and to character offsets of the original text.

The items are a stated set that is held against all documents. They are broadcast in blocks of about ``BLOCK_WORDS``
words, counted before, each block one more pass over the documents, so neither the driver nor a task ever holds a larger automaton.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasemill.llm import texts

BLOCK_WORDS = 100_000
_LOWER = texts._LOWER.astype(np.uint8)
_automata: dict[bytes, ahocorasick.Automaton] = {}

_SPAN = "array<struct<start:long,end:long>>"


def item_words(text: str | None) -> list[str]:
    data = (text or "").encode("utf-8", "replace")
    for block in texts.blocks(pa.array([data.decode()])):
        places = texts.words(block, texts.ALPHANUMERIC)
        low = _LOWER[block.data].tobytes()
        return [low[a:b].decode() for a, b in zip(places.start.tolist(), places.end.tolist())]
    return []


def item_windows(words: list[str], width: int) -> list[list[str]]:
    if not words:
        return []
    return [words[i : i + width] for i in range(max(1, len(words) - width + 1))]


def automaton(items: list[tuple[str, str | None]], width: int) -> ahocorasick.Automaton:
    """All windows of the items; the value of a window is (its number of words, the ids it belongs to)."""
    key = hashlib.sha256(repr((items, width)).encode("utf-8", "surrogatepass")).digest()
    if key not in _automata:
        owners: dict[str, tuple[int, set[str]]] = {}
        for item_id, text in items:
            for window in item_windows(item_words(text), width):
                owners.setdefault(f" {' '.join(window)} ", (len(window), set()))[1].add(item_id)
        built = ahocorasick.Automaton()
        for window, value in owners.items():
            built.add_word(window, value)
        built.make_automaton()
        _automata.clear()
        _automata[key] = built
    return _automata[key]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_TYPE = f"struct<n_words:long,items:array<string>,word_spans:{_SPAN},spans:{_SPAN}>"


def _scan(items: list[tuple[str, str | None]], width: int, column: pa.Array, before: pa.Array | None) -> pa.Array:
    """One pass: the items and spans that this block of items finds, with those found before."""
    found = automaton(items, width)
    parts = [[], [], [], []]
    for block in texts.blocks(column):
        places = texts.words(block, texts.ALPHANUMERIC)
        if before is None:
            owners, spans = [set() for _ in range(len(block))], [[] for _ in range(len(block))]
        else:
            earlier = before.slice(block.first, len(block)).to_pylist()
            owners = [set(x["items"]) for x in earlier]
            spans = [[(s["start"], s["end"]) for s in x["word_spans"]] for x in earlier]
        if len(found):
            _hits(block, places, found, owners, spans)
        spans = [_merged(x) for x in spans]
        parts[0] += np.diff(places.first).tolist()
        parts[1] += [sorted(x) for x in owners]
        parts[2] += spans
        parts[3] += _offsets(block, places, spans)
    return pa.StructArray.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.list_(pa.string())), _span_array(parts[2]), _span_array(parts[3])],
                                      ["n_words", "items", "word_spans", "spans"])


def _span_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], kind)


def _hits(block: texts.Block, places: texts.Words, found, items: list[set], spans: list[list]) -> None:
    inside = texts.ALPHANUMERIC[block.data]
    # A word's bytes and one blank after it; a word at the end of its text gets its blank below.
    keep = inside.copy()
    ends = places.end[places.end < block.bounds[places.text + 1]]
    keep[ends] = True
    blank = np.zeros(len(inside), bool)
    blank[ends] = ~inside[ends]
    low = np.where(blank, np.uint8(32), _LOWER[block.data])
    for i in range(len(block)):
        a, b = block.bounds[i], block.bounds[i + 1]
        if places.first[i] == places.first[i + 1]:
            continue
        text = " " + low[a:b][inside[a:b] | (keep[a:b] & blank[a:b])].tobytes().decode()
        if text[-1] != " ":
            text += " "
        blanks = None
        for end, (n, owners) in found.iter(text):
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
            after = int(np.searchsorted(blanks, end))
            spans[i].append((after - n, after))
            items[i] |= owners


def _offsets(block: texts.Block, places: texts.Words, spans: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Word spans as character offsets of the original text."""
    out = []
    for i, found in enumerate(spans):
        if not found:
            out.append([])
            continue
        a, b = block.bounds[i], block.bounds[i + 1]
        characters = np.concatenate([[0], np.cumsum((block.data[a:b] & 0xC0) != 0x80)])
        first = places.first[i]
        out.append([(int(characters[places.start[first + x] - a]), int(characters[places.end[first + y - 1] - a])) for x, y in found])
    return out


def _blocks(items: DataFrame, width: int) -> list[list[tuple[str, str | None]]]:
    """The items in lists of bounded size; the number of lists follows from their total length."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (6 * BLOCK_WORDS)))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n))
    return [sorted(map(tuple, rows.where(block == k).distinct().collect()), key=repr) for k in range(n)]


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, text: str = "text") -> Column:
    """Per text struct(n_words, items, word_spans, spans): ids with occurring windows, sorted as strings; hit words (half open,
    overlapping places merged); the same in characters of the original text.

    Null texts have no words. ``items(item_id, text, ...)`` without words have no windows; a null item_id counts as the empty string,
    and rows with one id are one item. Other columns are not looked at. Without items nothing is hit.
    """
    state = None
    for block in _blocks(items, width):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        state = _pass(shared, width, docs[text], state)
    return state


def _pass(shared, width: int, text: Column, state: Column | None) -> Column:
    if state is None:

        @F.arrow_udf(_TYPE)
        def first(column: pa.Array) -> pa.Array:
            return _scan(shared.value, width, column, None)

        return first(text)

    @F.arrow_udf(_TYPE)
    def later(column: pa.Array, before: pa.Array) -> pa.Array:
        return _scan(shared.value, width, column, before)

    return later(text, state)


def is_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, text: str = "text") -> Column:
    """Whether any window of an item occurs in the text; never null."""
    return F.size(contamination(docs, items, width, text)["items"]) > 0


def digest(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, one row per row of docs; no rows give none."""
    found = docs.select("doc_id", contamination(docs, items, width).alias("f")).select("doc_id", "f.*")
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
