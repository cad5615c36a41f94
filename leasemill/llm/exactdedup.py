"""Exact deduplication with a cuckoo-filter index of live digests.

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``; a null text counts as
empty. Of equal texts the row with the most code points in its original text stays, then the smallest doc_id (null last).

``CuckooIndex`` is the index of one shard: a cuckoo filter of 16-bit fingerprints, four to a bucket, and beside every
slot the place of the stored key it stands for. A lookup reads two buckets; a fingerprint that matches is verified
against the stored key, the whole SHA-256 of the normalised text; no text is held, so texts of equal SHA-256 count as equal. A key can be deleted again, and when an insertion finds no free
slot after ``KICKS`` moves, the filter is rebuilt at twice the size from the stored keys, so nothing is ever dropped.

On Spark, every task first folds its own copies, so that a text which makes up a third of all rows sends one row per
task; the folded rows are dealt to shards by digest and inserted there: a miss opens a group, a verified hit joins one.
A shard holds a bounded number of keys (``SHARD_KEYS`` on average), so its memory does not follow the corpus.
``build``, ``add`` and ``remove`` keep the index as a table, from which a later batch goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasemill.llm.store import stored

SLOTS, KICKS, LOAD = 4, 500, 0.9
SHARD_KEYS = 20_000
#: Distinct digests that a task folds at a time.
FOLD_ROWS = 200_000
SPACE = " \t\n\x0b\x0c\r"
_STEP = 0x5BD1E995


class CuckooIndex:
    """Live digests of one shard. A key is ``digest`` (bytes, 16 or more) with whatever its caller stores beside it."""

    def __init__(self, expected: int = 0):
        self.keys: list[bytes | None] = []
        self.places: dict[int, None] = {}
        self._allot(max(1, int(expected / (SLOTS * LOAD)) + 1))

    def _allot(self, buckets: int) -> None:
        self.mask = (1 << max(1, (buckets - 1).bit_length())) - 1
        size = (self.mask + 1) * SLOTS
        self.prints = [0] * size
        self.slots = [-1] * size

    @property
    def buckets(self) -> int:
        return self.mask + 1

    def _print_and_bucket(self, digest: bytes) -> tuple[int, int]:
        value = int.from_bytes(digest[:8], "little")
        return (value & 0xFFFF) or 1, (value >> 16) & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * _STEP)) & self.mask

    def find(self, digest: bytes) -> int:
        """The place of the stored key, or -1. A fingerprint alone never decides."""
        mark, bucket = self._print_and_bucket(digest)
        prints, slots, keys = self.prints, self.slots, self.keys
        for b in (bucket, self._other(bucket, mark)):
            for at in range(b * SLOTS, b * SLOTS + SLOTS):
                if prints[at] == mark and keys[slots[at]] == digest:
                    return slots[at]
        return -1

    def insert(self, digest: bytes) -> int:
        """Stores a key that is not in the index and returns its place."""
        place = len(self.keys)
        self.keys.append(digest)
        if not self._seat(digest, place):
            self._resize()
        return place

    def _seat(self, digest: bytes, place: int) -> bool:
        mark, bucket = self._print_and_bucket(digest)
        other = self._other(bucket, mark)
        prints, slots = self.prints, self.slots
        for b in (bucket, other):
            for at in range(b * SLOTS, b * SLOTS + SLOTS):
                if slots[at] < 0:
                    prints[at], slots[at] = mark, place
                    return True
        b = other
        for kick in range(KICKS):
            at = b * SLOTS + kick % SLOTS
            mark, prints[at] = prints[at], mark
            place, slots[at] = slots[at], place
            b = self._other(b, mark)
            for at in range(b * SLOTS, b * SLOTS + SLOTS):
                if slots[at] < 0:
                    prints[at], slots[at] = mark, place
                    return True
        return False

    def _resize(self) -> None:
        buckets = self.buckets
        while True:
            buckets *= 2
            self._allot(buckets)
            if all(self._seat(k, i) for i, k in enumerate(self.keys) if k is not None):
                return

    def delete(self, digest: bytes) -> int:
        """Takes a live key out and returns the place it had, or -1. Its slot is free for other keys."""
        mark, bucket = self._print_and_bucket(digest)
        for b in (bucket, self._other(bucket, mark)):
            for at in range(b * SLOTS, b * SLOTS + SLOTS):
                place = self.slots[at]
                if self.prints[at] == mark and place >= 0 and self.keys[place] == digest:
                    self.prints[at], self.slots[at], self.keys[place] = 0, -1, None
                    return place
        return -1


def digests(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text), points (code points of the original) and the carried columns, one row per row of docs."""
    text = F.coalesce(docs["text"], F.lit(""))
    sha = F.unhex(F.sha2(F.encode(F.translate(text, SPACE, ""), "UTF-8"), 256))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), sha.alias("digest"), F.length(text).cast("long").alias("points"), *carry)


def _better(a: tuple, b: tuple) -> bool:
    """Whether (points, doc_id) a goes before b: more code points, then the smaller doc_id, null last."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


_GROUP = "digest binary, points long, keep_id long, size long"


def _record(groups: dict[bytes, tuple], extra: dict | None = None) -> pa.RecordBatch:
    keys = list(groups)
    columns = {
        "digest": pa.array(keys, pa.binary()),
        "points": pa.array([groups[k][0] for k in keys], pa.int64()),
        "keep_id": pa.array([groups[k][1] for k in keys], pa.int64()),
        "size": pa.array([groups[k][2] for k in keys], pa.int64()),
    }
    return pa.RecordBatch.from_pydict(columns | (extra or {}))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a task become one row; at most FOLD_ROWS digests are held."""
    groups: dict[bytes, tuple] = {}
    for batch in batches:
        for digest, points, doc_id in zip(*(batch.column(c).to_pylist() for c in ("digest", "points", "doc_id"))):
            old = groups.get(digest)
            if old is None:
                groups[digest] = (points, doc_id, 1)
            else:
                best = (points, doc_id) if _better((points, doc_id), old) else old[:2]
                groups[digest] = (*best, old[2] + 1)
        if len(groups) >= FOLD_ROWS:
            yield _record(groups)
            groups = {}
    yield _record(groups)


def _insert_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one shard go through its cuckoo index: a miss opens a group, a verified hit joins the group it finds."""
    index = CuckooIndex(len(rows))
    best: list[tuple] = []
    ids = [None if pd.isna(x) else int(x) for x in rows["keep_id"].astype("object")]
    for digest, points, doc_id, size in zip(rows["digest"], rows["points"].tolist(), ids, rows["size"].tolist()):
        place = index.find(digest)
        if place < 0:
            index.insert(digest)
            best.append((points, doc_id, size))
        else:
            old = best[place]
            first = (points, doc_id) if _better((points, doc_id), old) else old[:2]
            best[place] = (*first, old[2] + size)
    return pd.DataFrame({
        "digest": index.keys,
        "points": np.array([b[0] for b in best], np.int64),
        "keep_id": pd.array([b[1] for b in best], dtype="Int64"),
        "size": np.array([b[2] for b in best], np.int64),
    })


def _sharded(folded: DataFrame) -> DataFrame:
    """Deals the rows of a group table to shards by digest and merges equal digests there."""
    n = folded.count()
    shards = max(1, -(-n // SHARD_KEYS))
    folded = folded.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return folded.groupBy("shard").applyInPandas(_insert_shard, _GROUP)


def build(digested: DataFrame) -> DataFrame:
    """The index of all live digests: digest, points, keep_id, size; one row per distinct normalised text."""
    folded = stored(digested.mapInArrow(_fold, _GROUP), "folded")
    return stored(_sharded(folded), "index")


def add(index: DataFrame, digested: DataFrame) -> DataFrame:
    """The index after inserting another batch."""
    folded = digested.mapInArrow(_fold, _GROUP)
    return stored(_sharded(stored(index.unionByName(folded), "folded")), "index")


def remove(index: DataFrame, dead: DataFrame) -> DataFrame:
    """The index without the digests of ``dead(digest)``; digests that are not in it change nothing."""

    def strike(rows: pd.DataFrame) -> pd.DataFrame:
        live, gone = rows[~rows["dead"]].reset_index(drop=True), rows[rows["dead"]]
        cuckoo = CuckooIndex(len(live))
        for digest in live["digest"]:
            cuckoo.insert(digest)
        for digest in gone["digest"]:
            cuckoo.delete(digest)
        return live[[k is not None for k in cuckoo.keys]][["digest", "points", "keep_id", "size"]]

    dead = dead.select("digest").distinct().select(
        "digest", F.lit(0).cast("long").alias("points"), F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("dead"))
    both = stored(index.withColumn("dead", F.lit(False)).unionByName(dead), "struck")
    shards = max(1, -(-both.count() // SHARD_KEYS))
    both = both.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return stored(both.groupBy("shard").applyInPandas(strike, _GROUP), "index")


def exact_duplicates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, keep_id, group_size, kept, text_sha256 (hex) and the carried columns.

    Repeated rows are copies of one another: where the row that stays occurs several times, all of those rows have its
    doc_id, and ``kept`` is true on each, as no column tells them apart. Null doc_ids take part and match each other.
    Other columns are not looked at; no rows give no rows.
    """
    digested = stored(digests(docs, carry), "digests")
    index = build(digested).select("digest", "keep_id", F.col("size").alias("group_size"), F.col("points").alias("most"))
    out = digested.join(index, "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *carry)
