"""Bounded samples of labelled rows, and linear models on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasemill.llm.store import stored

#: Of the remainders 0 to 3 of a doc_id's checksum, the one that is never learnt from.
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 marks the row as held out; a null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def thinned(df: DataFrame, key: str, limit: int) -> DataFrame:
    """About ``limit`` rows at most, chosen by a hash of their key: the same rows for the same table, however it is split."""
    n = df.count()
    if n <= limit:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < int((1 << 30) * limit / n))


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """A stored table (text, label) of about ``limit`` labelled rows at most, held-out rows never among them.

    Several labels of one doc_id count as their largest; null labels and ids are no labels. The labels are broadcast: no
    more than ``limit`` ids and numbers.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = thinned(known.where("doc_id is not null"), "doc_id", limit)
    return stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label"), "sample")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, outputs) and intercepts of logistic models with an L2 penalty, by accelerated gradient steps.

    ``x`` may hold small integers or half floats; it is widened a chunk of rows at a time.
    """
    n, width = x.shape
    y = y.reshape(n, -1).astype(np.float32)
    wide = lambda at: x[at : at + chunk].astype(np.float32)
    v = np.random.Generator(np.random.PCG64(1)).standard_normal(width + 1).astype(np.float32)
    largest = 1.0
    for _ in range(12):
        v /= np.linalg.norm(v)
        product = np.zeros_like(v)
        for at in range(0, n, chunk):
            part = wide(at)
            z = part @ v[:-1] + v[-1]
            product[:-1] += part.T @ z
            product[-1] += z.sum()
        largest, v = float(v @ product), product
    step = 1 / (0.25 * 1.1 * largest / n + penalty)
    w, b = np.zeros((width, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(rounds):
        dw, db = np.zeros_like(w), np.zeros_like(b)
        for at in range(0, n, chunk):
            part = wide(at)
            off = sigmoid(part @ ahead_w + ahead_b) - y[at : at + chunk]
            dw += part.T @ off
            db += off.sum(axis=0)
        new_w, new_b = ahead_w - step * (dw / n + penalty * ahead_w), ahead_b - step * db / n
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead_w, ahead_b = new_w + (before - 1) / t * (new_w - w), new_b + (before - 1) / t * (new_b - b)
        w, b = new_w, new_b
    return w, b
