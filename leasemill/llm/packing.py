"""Best-two-fit packing of tokenised documents into sequences of at most ``size`` tokens.

A document's ids are those of the given vocabulary followed by the end id. Longer ones are cut into pieces of ``size``; the
first piece takes the remainder. Then bins are filled one after the other: greedily, always the largest unpacked piece
that fits; where room is left, the bin's smallest piece is replaced by two unpacked pieces that fill its room better.

What best-two-fit does depends only on how many pieces there are of each length, at most ``size`` numbers however large
the corpus. So the bins are planned on that histogram, with equal bins planned once together with their number, and the plan, a table
whose size is bounded by ``size`` alone, tells the k-th piece of a length its sequence and place. Pieces are numbered
within their length by task and position in it: no window over a length, no pieces in the driver, no shuffle of ids.
"""

from __future__ import annotations

import array
import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leasemill.llm.store import stored

END_ID = 2
#: Chunks whose ids a worker remembers: about 40 MB.
REMEMBERED = 150_000
#: Characters of text that are tokenised at a time.
GROUP_CHARS = 1 << 18

_CUT = re.compile(r"(?= \S)")
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


class Encoder:
    """Ids of a byte-level vocabulary as little-endian uint32, the same as ``Tokenizer.from_file(path).encode`` without special tokens.

    No token of the vocabulary spans a blank before a visible character, so texts are cut there and the ids of a chunk
    are remembered. Chunks not seen yet are encoded together, from the same vocabulary's ranks where a ranks file is given.

    With ``added_tokens`` a text is first split at the vocabulary's added tokens, such as an end of text, which have their own ids, as
    ``encode`` does by default. Without, they are plain text, as they are with the tokenizer's ``encode_special_tokens``.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None, added_tokens: bool = False):
        self.known: dict[str, bytes] = {}
        self.added = _added(vocabulary) if added_tokens else {}
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        if ranks is None:
            tokenizer = Tokenizer.from_file(vocabulary)
            tokenizer.encode_special_tokens = True
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        else:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.encode = encoding.encode_ordinary
            self.width = np.zeros(max(table.values()) + 1, np.int64)
            for token, i in table.items():
                self.width[i] = len(token)
        self.joined = ranks is not None

    def _learn(self, chunks: list[str]) -> None:
        """Chunks begin with a blank and a visible character, so their joined text falls apart at the same places."""
        known = self.known
        if not self.joined:
            for c in chunks:
                known[c] = array.array("I", self.encode(c)).tobytes()
            return
        ids = np.array(self.encode("".join(chunks)), np.uint32)
        stops = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(c.encode()) for c in chunks])) + 1
        data, at = ids.tobytes(), 0
        for c, to in zip(chunks, (4 * stops).tolist()):
            known[c] = data[at:to]
            at = to

    def many(self, group: list[str]) -> list[bytes]:
        if not self.splits:
            return self._plain(group)
        # Every second part is an added token.
        split = [self.splits.split(text) for text in group]
        plain = iter(self._plain([part for parts in split for part in parts[::2]]))
        return [b"".join(self.added[part] if k % 2 else next(plain) for k, part in enumerate(parts)) for parts in split]

    def _plain(self, group: list[str]) -> list[bytes]:
        parts = []
        for text in group:
            if _ODD_SPACE.search(text):
                head, *rest = _CUT.split(text)
            else:
                head, *rest = text.split(" ")
                rest = [" " + c for c in rest]
            parts.append((head, rest))
        new = set().union(*(rest for _, rest in parts)).difference(self.known)
        if len(new) + len(self.known) > REMEMBERED:
            self.known.clear()
            new = set().union(*(rest for _, rest in parts))
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        return [array.array("I", self.encode(head)).tobytes() + b"".join(map(get, rest)) for head, rest in parts]


def _added(vocabulary: str) -> dict[str, bytes]:
    """The added tokens of a vocabulary and their ids. Those that look at their neighbours or at normalised text are refused."""
    with open(vocabulary, encoding="utf-8") as file:
        given = json.load(file)
    out = {}
    for token in given.get("added_tokens") or ():
        if token.get("single_word") or token.get("lstrip") or token.get("rstrip") or (token.get("normalized") and given.get("normalizer")):
            raise ValueError(f"no support for the options of the added token {token['content']}")
        out[token["content"]] = array.array("I", [token["id"]]).tobytes()
    return out


_encoders: dict[tuple, Encoder] = {}


def _encoder(*given: str | bool | None) -> Encoder:
    if given not in _encoders:
        _encoders[given] = Encoder(*given)
    return _encoders[given]


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    lengths = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(lengths)
    at = 0
    while at < len(column):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + GROUP_CHARS, "right")))
        yield at, [x or "" for x in column.slice(at, to - at).to_pylist()]
        at = to


def _pieces(files: tuple, size: int):
    """Maps (doc_id, text) to pieces; ``part`` and ``nth`` number the pieces of one length within their task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        encoder = _encoder(*files)
        end = array.array("I", [END_ID]).tobytes()
        for batch in batches:
            for at, group in _groups(batch.column("text")):
                owner, piece, start, length, nth, data = [], [], [], [], [], []
                for i, ids in enumerate(encoder.many(group)):
                    ids += end
                    n = len(ids) // 4
                    a = 0
                    b = n % size or size
                    k = 0
                    while a < n:
                        owner.append(at + i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        nth.append(seen[b - a])
                        seen[b - a] += 1
                        data.append(ids[4 * a : 4 * b])
                        a, b, k = b, b + size, k + 1
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array(owner, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int32()),
                    "part": pa.array([part] * len(piece), pa.int32()),
                    "nth": pa.array(nth, pa.int64()),
                    "ids": pa.array(data, pa.binary()),
                })

    return rows


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, size: int = 1024, added_tokens: bool = False) -> DataFrame:
    """A stored table of pieces of ``docs(doc_id, text, ...)``: doc_id, piece, start, length, part, nth, ids (uint32, little-endian).

    Null texts are empty and, like empty ones, have the end id alone. Repeated rows are packed each for itself.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length int, part int, nth long, ids binary"
    return stored(docs.select("doc_id", "text").mapInArrow(_pieces((vocabulary, ranks, pattern, added_tokens), size), schema), "pieces")


def plan_bins(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit over a histogram of lengths: (lengths of a bin, how many such bins), in order of filling."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins: list[tuple[tuple[int, ...], int]] = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return bins
        taken: dict[int, int] = {}
        room = size
        while room:
            i = np.searchsorted(there, room, "right") - 1
            while i >= 0 and taken.get(int(there[i]), 0) >= left[there[i]]:
                i -= 1
            if i < 0:
                break
            length = int(there[i])
            n = min(room // length, int(left[length]) - taken.get(length, 0))
            taken[length] = taken.get(length, 0) + n
            room -= n * length
        held = dict(taken)
        if room:
            smallest = min(taken)
            pair = _better_pair(left, taken, smallest, room + smallest)
            if pair:
                taken[smallest] -= 1
                for x in pair:
                    taken[x] = taken.get(x, 0) + 1
                    held[x] = held.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in held.items())
        lengths = tuple(x for x in sorted(taken, reverse=True) for _ in range(taken[x]))
        for x, n in taken.items():
            left[x] -= n * times
        bins.append((lengths, times))


def _better_pair(left: np.ndarray, taken: dict[int, int], smallest: int, gap: int) -> tuple[int, int] | None:
    """Two unpacked lengths of the largest sum that fits the gap, if that is more than the smallest piece fills."""
    free = left[: gap + 1].copy()
    for x, n in taken.items():
        if x <= gap:
            free[x] -= n
    there = np.flatnonzero(free > 0)
    if not len(there):
        return None
    at = np.searchsorted(there, gap - there, "right") - 1
    ok = at >= 0
    first, second = there[ok], there[at[ok]]
    alone = (first == second) & (free[first] < 2)
    lower = np.where(alone, at[ok] - 1, at[ok])
    first, second = first[lower >= 0], there[lower[lower >= 0]]
    if not len(first):
        return None
    best = int(np.argmax(first + second))
    a, b = int(first[best]), int(second[best])
    return (a, b) if a + b > smallest else None


def slots(bins: list[tuple[tuple[int, ...], int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length the runs of its pieces: keys (length, first number), the sequence of the first, the offset in the sequence."""
    used = np.zeros(size + 1, np.int64)
    keys, sequences, offsets = [], [], []
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for length in lengths:
            keys.append((length, used[length]))
            sequences.append(sequence)
            offsets.append(offset)
            used[length] += times
            offset += length
        sequence += times
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return np.array([keys[i] for i in order], np.int64).reshape(-1, 2), np.array(sequences, np.int64)[order], np.array(offsets, np.int64)[order]


def _place(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = shared.value
        first = np.searchsorted(keys[:, 0], np.arange(keys[-1, 0] + 2) if len(keys) else np.zeros(1))
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            number = batch.column("number").to_numpy()
            at = np.zeros(len(batch), np.int64)
            for x in np.unique(length):
                mine = length == x
                run = keys[first[x] : first[x + 1], 1]
                at[mine] = first[x] + np.searchsorted(run, number[mine], "right") - 1
            sequence = sequences[at] + number - keys[at, 1]
            columns = {name: batch.column(name) for name in batch.schema.names if name != "number"}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence), "offset": pa.array(offsets[at])})

    return rows


def place(cut: DataFrame, size: int = 1024) -> DataFrame:
    """Packs pieces: the columns of ``cut`` (length, part, nth and any others) without part and nth, and sequence_id and offset."""
    spark = cut.sparkSession
    counts = stored(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = cut.join(bases, ["length", "part"]).withColumn("number", F.col("base") + F.col("nth")).drop("base", "nth", "part")
    shared = spark.sparkContext.broadcast(slots(plan_bins(totals, size), size))
    kept = [f for f in numbered.schema if f.name != "number"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return numbered.mapInArrow(_place(shared), schema)


def sequences(cut: DataFrame, size: int = 1024) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (uint32, little-endian) and length, from a table of ``pieces``.

    The ids travel with their pieces, so repeated rows and rows without an id are packed each for itself like any other. A sequence
    holds ``size`` ids at most.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return place(cut.select("length", "part", "nth", "ids"), size).groupBy("sequence_id").agg(
        F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"]))).alias("hex"), "length").select(
        "sequence_id", F.unhex("hex").alias("ids"), "length")


def packed(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, size: int = 1024, added_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every document. No rows give no rows."""
    cut = pieces(docs, vocabulary, ranks, pattern, size, added_tokens)
    slim = cut.select("doc_id", "piece", "start", "length", "part", "nth", F.crc32("ids").alias("ids_crc32"))
    out = place(slim, size)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
