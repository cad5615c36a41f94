"""Product-quantised vector codes; the nearest codebook entry is found by Orchard's search.

Every component x becomes the integer floor(4096 * x), a vector is cut into equal consecutive parts, and each part position has a
codebook of its own, trained by rounds of assignment and averaging. All arithmetic is on integers, so the result does
not depend on how the rows are dealt out.

Orchard's search keeps for every entry a list of the other entries, nearest first. It walks the list of the best entry so far; an
entry that improves on it is jumped to and its list is walked from the start. Entries met before are marked and not measured
again. The walk ends beyond twice the current distance: such an entry is farther from the part than the current one. Ties
go to the lower index, and the bound is strict, so equally near entries are always met. All parts of a batch walk together.

A round reduces every task to one row per entry (at most parts x entries rows of sums); Spark adds these up and the driver holds
the codebooks, nothing else.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasemill.llm import groups
from leasemill.llm.store import stored

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6


def largest(length: int) -> int:
    """The largest component of vectors of a length for which all squared distances fit 64 bits."""
    return math.isqrt((1 << 62) // length) // 2


class Codebooks:
    """Entries (parts, entries, width) with the sorted neighbour lists of Orchard's search."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        parts, k, _ = entries.shape
        between = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(axis=3)
        # Entry e is beyond twice the distance d of the current one c: |ce| > 2d, in squares ceil(|ce|**2 / 4) > d**2.
        self.quarter = (between + 3) // 4
        order = np.argsort(between, axis=2, kind="stable")
        self.lists = order[order != np.arange(k)[None, :, None]].reshape(parts, k, k - 1)
        # The entry nearest to all others: a short way to most places.
        self.start = between.astype(float).sum(axis=2).argmin(axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry per vector (rows, parts, width) and part; how many distances were taken."""
        rows, parts, width = vectors.shape
        k = self.entries.shape[1]
        x = vectors.reshape(rows * parts, width)
        part = np.tile(np.arange(parts), rows)
        best = self.start[part]
        distance = ((x - self.entries[part, best]) ** 2).sum(axis=1)
        visited = np.zeros((rows * parts, k), bool)
        visited[np.arange(rows * parts), best] = True
        place = np.zeros(rows * parts, np.int64)
        walking = np.arange(rows * parts) if k > 1 else np.zeros(0, np.int64)
        taken = rows * parts
        while len(walking):
            p, c = part[walking], best[walking]
            e = self.lists[p, c, place[walking]]
            within = self.quarter[p, c, e] <= distance[walking]
            walking, p, c, e = walking[within], p[within], c[within], e[within]
            new = ~visited[walking, e]
            place[walking] += 1
            at, found = walking[new], e[new]
            visited[at, found] = True
            d = ((x[at] - self.entries[p[new], found]) ** 2).sum(axis=1)
            taken += len(at)
            better = (d < distance[at]) | ((d == distance[at]) & (found < c[new]))
            at = at[better]
            best[at], distance[at], place[at] = found[better], d[better], 0
            walking = walking[place[walking] < k - 1]
        return best.reshape(rows, parts), distance.reshape(rows, parts), taken

    def sha256(self) -> str:
        """Digest of all entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _vectors(column: pa.Array, parts: int) -> np.ndarray:
    """A list column of one length, without nulls, as (rows, parts, width)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def whole_numbers(vectors: DataFrame, parts: int = PARTS, vector: str = "embedding") -> DataFrame:
    """The stored table (vec_id, label, v): kept vectors as integers, all of one length.

    Dropped are null vectors, those with a null or non-finite component, those whose length is no positive multiple of ``parts``,
    and those of another length than the first (the kept vector with the smallest vec_id). Components too large for exact
    64-bit distances (beyond 32,768 at 64 components) count as the largest that fits.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    fits = (F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite
    usable = vectors.where(F.col(vector).isNotNull() & F.coalesce(fits, F.lit(False)))
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), vector).select(F.size(vector)).first()
    length = first[0] if first else parts
    top = F.lit(largest(length)).cast("double")
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, top), -top)).cast("int"))
    return stored(usable.where(F.size(vector) == length).select("vec_id", "label", whole.alias("v")), "vectors")


def first_entries(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest vec_ids (null last; ties by their components), fewer where there are fewer."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    vectors = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), parts, -1 if rows else 1)
    return vectors.transpose(1, 0, 2)


def improved(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floor of the mean of the parts nearest to it; unused entries stay."""
    parts, k, width = books.entries.shape
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        count = np.zeros(parts * k, np.int64)
        total = np.zeros((parts * k, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(0), parts)
                entry = (books.nearest(x)[0] + np.arange(parts) * k).ravel()
                count += np.bincount(entry, minlength=parts * k)
                np.add.at(total, entry, x.reshape(-1, width))
        used = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * width, pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), sums], ["entry", "n", "sums"])

    by_task = kept.select("v").mapInArrow(summed, "entry long, n long, sums array<long>")
    added = by_task.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    entries = books.entries.copy().reshape(parts * k, width)
    for r in added.collect():  # at most parts * k rows
        entries[r["entry"]] = [s // r["n"] for s in r["sums"]]
    shared.unpersist()
    return Codebooks(entries.reshape(parts, k, width))


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """The codebooks of a table of ``whole_numbers``; None for a table without rows."""
    first = first_entries(kept, parts, entries)
    if not first.size:
        return None
    books = Codebooks(first)
    for _ in range(rounds):
        books = improved(kept, books)
    return books


def encoded(vector: Column, books: Codebooks) -> Column:
    """struct(code, errors): the entry of each part, two hexadecimal digits each in part order (four beyond 256 entries), and its squared distance."""
    parts, k, _ = books.entries.shape
    digits = 2 if k <= 256 else 4

    @F.arrow_udf("struct<code:string,errors:array<long>>")
    def codes(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.struct([("code", pa.string()), ("errors", pa.list_(pa.int64()))]))
        entry, distance, _ = books.nearest(_vectors(column, parts))
        names = [f"{i:0{digits}x}" for i in range(k)]
        text = ["".join([names[e] for e in row]) for row in entry.tolist()]
        errors = pa.ListArray.from_arrays(np.arange(len(column) + 1, dtype=np.int32) * parts, pa.array(distance.ravel()))
        return pa.StructArray.from_arrays([pa.array(text, pa.string()), errors], ["code", "errors"])

    return codes(vector)



def digest(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256, one row per kept row of ``vectors(vec_id, label, embedding, ...)``.

    Repeated rows are rows of their own, null ids and labels stay (null labels are one label), other columns are not looked at.
    A table without kept rows gives none.
    """
    kept = whole_numbers(vectors, vector=vector)
    books = train(kept)
    if books is None:
        return kept.selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    total = F.aggregate("f.errors", F.lit(0).cast("long"), lambda a, b: a + b)
    found = kept.select("vec_id", "label", encoded(F.col("v"), books).alias("f"))
    found = stored(found.select("vec_id", "label", "f.code", total.alias("error")), "codes")
    sums = found.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    out = groups.joined(found, stored(sums, "labels"), "label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
