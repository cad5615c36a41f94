"""Language identification by error-correcting output codes.

Every language has a codeword. For each of its bits a logistic classifier on character n-grams (lengths 1 to 4, hashed, as
shares of the text's n-grams) tells the languages with a 1 from those with a 0. A text goes to the language whose codeword
has the smallest loss, with each bit weighted by how well its classifier does on the sample; if the next language is close,
the text is flagged as ambiguous. Up to seven languages have all bits that split them, more get random codewords of
``CODE`` times the shortest possible length, chosen for a large distance between rows.

The sample takes ``SAMPLE`` rows at most, the same number from each language where there are enough. All languages of
the training rows take part; the driver sees their names, their counts and the sample's n-gram shares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasemill.llm import ngrams
from leasemill.llm.store import stored
from leasemill.llm.training import fit_logistic, held_out, sigmoid

ORDERS, BITS = (1, 2, 3, 4), 12
SAMPLE, PENALTY, CODE = 6_000, 1e-6, 6
#: Shares of n-grams are small numbers; this brings them to about 1.
SCALE = 64.0
AMBIGUOUS = 0.2
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def codewords(n: int) -> np.ndarray:
    """0/1 rows, one per language: all splits up to seven languages, else the best of some random codes."""
    if n <= 1:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        # Splits in which the first language has a 1, without the one that separates nothing.
        splits = np.arange((1 << (n - 1)) - 1)
        rest = (splits[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.vstack([np.ones(len(splits), int), rest]).astype(np.int8)
    length = CODE * int(np.ceil(np.log2(n)))
    rng = np.random.Generator(np.random.PCG64(n))
    best, distance = None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (n, length), dtype=np.int8)
        split = code.any(axis=0) & ~code.all(axis=0)
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)
        least = int(apart[~np.eye(n, dtype=bool)].min())
        if split.all() and least > distance:
            best, distance = code, least
    return best if best is not None else np.eye(n, dtype=np.int8)


def shares(column: pa.Array) -> np.ndarray:
    """Rows of n-gram shares, by bucket; rows without letters are 0."""
    counts = np.zeros((len(column), 1 << BITS), np.float32)
    for block in ngrams.blocks(column, max(ORDERS), ngrams.letters_only):
        for n in ORDERS:
            bucket, row = block.buckets(n, BITS)
            at, n_at = np.unique(row * (1 << BITS) + bucket, return_counts=True)
            counts.reshape(-1)[at] += n_at
    return SCALE * counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int8))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    intercepts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bit_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, column: pa.Array) -> np.ndarray:
        bits = self.weights.shape[1]
        sums, total = np.zeros((len(column), bits)), np.zeros(len(column))
        for block in ngrams.blocks(column, max(ORDERS), ngrams.letters_only):
            for n in ORDERS:
                bucket, row = block.buckets(n, BITS)
                if not len(row):
                    continue
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                rows = row[first]
                total[rows] += np.diff(np.r_[first, len(row)])
                sums[rows] += np.add.reduceat(self.weights[bucket], first, axis=0)
        return SCALE * sums / np.maximum(total, 1)[:, None] + self.intercepts

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword, its share of the likelihood over all codewords, and whether another one is close."""
        sign = 2.0 * self.code - 1
        loss = np.zeros((len(margins), len(self.languages)))
        for c in range(len(self.languages)):
            loss[:, c] = (np.logaddexp(0, -sign[c] * margins) * self.bit_weights).sum(axis=1)
        likelihood = np.exp(loss.min(axis=1, keepdims=True) - loss)
        likelihood /= likelihood.sum(axis=1, keepdims=True)
        best = likelihood.argmax(axis=1)
        ordered = np.sort(likelihood, axis=1)
        second = ordered[:, -2] if likelihood.shape[1] > 1 else np.zeros(len(margins))
        return best, ordered[:, -1], ordered[:, -1] - second < AMBIGUOUS

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        known = np.array([bool(t and _LETTER.search(t)) for t in column.to_pylist()], bool)
        if not self.languages or not len(column):
            return [UNDETERMINED] * len(column), np.zeros(len(column)), known
        best, share, close = self.decode(self.margins(column))
        names = [self.languages[i] if k else UNDETERMINED for i, k in zip(best, known)]
        return names, np.where(known, share, 0.0), close & known


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            data = [x.tobytes() for x in shares(part.column("text")).astype(np.float16)]
            yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "shares": pa.array(data, pa.binary())})


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the rows of ``docs(doc_id, text, lang, ...)`` that have a language, a text and are not held out."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([])
    code = codewords(len(languages))
    if not code.shape[1]:
        return Model(languages, code)
    each = sample / len(languages)
    cut = F.lit(0)
    for name, n in counts.items():
        cut = F.when(F.col("lang") == name, int((1 << 30) * min(1.0, each / n))).otherwise(cut)
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < cut).select("lang", "text")
    rows = stored(chosen, "sample").mapInArrow(_sample_rows, "lang string, shares binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["shares"])))
    x = np.frombuffer(b"".join(bytes(r["shares"]) for r in rows), np.float16).reshape(len(rows), 1 << BITS)
    y = code[[languages.index(r["lang"]) for r in rows]]
    weights, intercepts = fit_logistic(x, y, PENALTY, rounds=150, chunk=512)
    right = np.zeros(code.shape[1])
    for at in range(0, len(rows), 512):
        right += ((sigmoid(x[at : at + 512].astype(np.float32) @ weights + intercepts) >= 0.5) == y[at : at + 512]).sum(axis=0)
    share = np.clip(right / len(rows), 0.5 + 1e-6, 1 - 1e-3)
    bit_weights = np.log(share / (1 - share))
    return Model(languages, code, weights, intercepts, bit_weights / bit_weights.mean())


def identify(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """struct(lang, score, ambiguous) of a text; ``und`` with score 0 where it is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def language(column: pa.Array) -> pa.Array:
        names, share, close = shared.value.predict(column)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(close, pa.bool_())],
                                          ["lang", "score", "ambiguous"])

    return language(docs[text])
