"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios, trained on labelled text.

A feature says whether an n-gram of 3 to 10 lower-cased characters, blanks included, occurs in the text. The log
ratio of its share in toxic and in other texts scales it; a logistic model is fitted on the scaled features.
The ``FEATURES`` n-grams whose ratio stands out most against its own uncertainty take part. They are found in two rounds of counting over
the whole sample: by the first ``BITS`` bits of their 32-bit hashes, then by whole hashes in the buckets that stand out.

Counts are taken by the executors; the driver sees the chosen n-grams and one bit per sampled text and feature. The
sample is ``SAMPLE`` labelled rows at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasemill.llm import ngrams
from leasemill.llm.training import fit_logistic, labelled, sigmoid

ORDERS, BITS = (3, 4, 5, 6, 8, 10), 20
SAMPLE, BUCKETS, FEATURES, SMOOTH, PENALTY, ROUNDS = 16_000, 4096, 1024, 0.5, 1e-3, 200
THRESHOLD = 0.3
_SHIFT = np.uint32(32 - BITS)


class Chosen:
    """A sorted set of n-gram hashes, with a bit table in front of it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint32))
        self.table = np.zeros(1 << BITS, bool)
        self.table[self.hashes >> _SHIFT] = True

    def places(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, place in ``hashes``) of the set's n-grams in the texts."""
        found = [np.zeros(0, np.int64)]
        n = len(self.hashes)
        for block in ngrams.blocks(column, max(ORDERS)) if n else ():
            for order in ORDERS:
                h, row = block.hashes(order)
                near = self.table[h >> _SHIFT]
                h, row = h[near], row[near]
                at = np.minimum(np.searchsorted(self.hashes, h), n - 1)
                hit = self.hashes[at] == h
                found.append(np.unique(row[hit] * n + at[hit]))
        keys = np.unique(np.concatenate(found))
        return keys // max(n, 1), keys % max(n, 1)


@dataclass
class Model:
    intercept: float
    chosen: Chosen = field(default_factory=lambda: Chosen(np.zeros(0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, column: pa.Array) -> np.ndarray:
        row, at = self.chosen.places(column)
        return sigmoid(np.bincount(row, self.weights[at], len(column)) + self.intercept)


def _text_hashes(column: pa.Array, i: int) -> Iterator[np.ndarray]:
    for block in ngrams.blocks(column.slice(i, 1), max(ORDERS)):
        for order in ORDERS:
            yield block.hashes(order)[0]


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that have an n-gram of a bucket."""
    counts, there = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, bool)
    for batch in batches:
        column = batch.column("text")
        for i, label in enumerate(batch.column("label").to_pylist()):
            for h in _text_hashes(column, i):
                there[h >> _SHIFT] = True
            at = np.flatnonzero(there)
            counts[label, at] += 1
            there[at] = False
    seen = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_pydict({"gram": seen, "n0": counts[0, seen], "n1": counts[1, seen]})


def _gram_counts(buckets: np.ndarray):
    """Texts of either label that have an n-gram, for the n-grams of some buckets."""
    table = np.zeros(1 << BITS, bool)
    table[buckets] = True

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            grams, labels = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            for i, label in enumerate(batch.column("label").to_pylist()):
                own = np.unique(np.concatenate([np.zeros(0, np.uint32), *(h[table[h >> _SHIFT]] for h in _text_hashes(column, i))]))
                grams.append(own)
                labels.append(np.full(len(own), label))
            gram, back = np.unique(np.concatenate(grams), return_inverse=True)
            label = np.concatenate(labels)
            n1 = np.bincount(back, label, len(gram)).astype(np.int64)
            n0 = np.bincount(back, 1 - label, len(gram)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"gram": gram.astype(np.int64), "n0": n0, "n1": n1})

    return rows


def _rows_of(chosen: Chosen):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                ones = np.zeros((len(part), len(chosen.hashes)), bool)
                ones[chosen.places(part.column("text"))] = True
                packed = [x.tobytes() for x in np.packbits(ones, axis=1)]
                yield pa.RecordBatch.from_pydict({"label": part.column("label"), "ones": pa.array(packed, pa.binary())})

    return rows


def _outstanding(counts: DataFrame, n0: int, n1: int, limit: int) -> list:
    """(gram, ratio) of those whose log ratio is largest against its standard deviation."""
    counts = counts.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p1, p0 = F.col("n1") + SMOOTH, F.col("n0") + SMOOTH
    ratio = F.log(p1 / (n1 + 2 * SMOOTH)) - F.log(p0 / (n0 + 2 * SMOOTH))
    z = F.abs(ratio) / F.sqrt(1 / p1 + 1 / p0)
    return counts.select("gram", ratio.alias("ratio"), z.alias("z")).orderBy(F.desc("z"), "gram").limit(limit).collect()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from ``labels(doc_id, toxic)`` of rows that are not held out. With labels of one kind only, or none, the score is near 1 or 0 for all."""
    texts = labelled(docs, labels, "toxic", sample).withColumn("label", (F.col("label") > 0).cast("int"))
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model(20.0 if n1 else -20.0)
    kind = "gram long, n0 long, n1 long"
    buckets = _outstanding(texts.mapInArrow(_bucket_counts, kind), n0, n1, BUCKETS)
    counts = texts.mapInArrow(_gram_counts(np.array([r["gram"] for r in buckets], np.int64)), kind)
    grams = sorted((r["gram"], r["ratio"]) for r in _outstanding(counts, n0, n1, FEATURES))
    if not grams:
        return Model(float(np.log(n1 / n0)))
    chosen = Chosen(np.array([g for g, _ in grams], np.int64))
    ratios = np.array([r for _, r in grams], np.float32)
    rows = texts.mapInArrow(_rows_of(chosen), "label int, ones binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["ones"])))
    ones = np.unpackbits(np.frombuffer(b"".join(bytes(r["ones"]) for r in rows), np.uint8).reshape(len(rows), -1), axis=1, count=len(grams))
    w, b = fit_logistic((ones * ratios).astype(np.float16), np.array([r["label"] for r in rows]), PENALTY, ROUNDS)
    return Model(float(b[0]), chosen, (w[:, 0] * ratios).astype(np.float64))


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The probability that a text is toxic, as a column. Null and empty texts have the score of no features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxic(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(column))

    return toxic(docs[text])
