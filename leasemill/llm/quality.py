"""Quality: a generalised additive model with pairwise interactions on measures of the text.

Every measure is cut into bins at quantiles of the sample. Cyclic boosting goes round the measures and adds a shallow tree
on one of them at a time, which only ever changes that measure's lookup table of one value per bin. Then the pairs
of measures whose joint bins explain most of what is left get tables of their own, boosted in the same way. A text's
score is the sum of one table entry per measure and per pair: a few vectorised lookups and additions.

The fit sees ``SAMPLE`` labelled rows at most, as rows of measures; texts stay on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasemill.llm import texts
from leasemill.llm.training import labelled, sigmoid

SAMPLE, BINS, ROUNDS, RATE, LEAVES = 16_000, 32, 200, 0.1, 3
PAIRS, PAIR_ROUNDS, COARSE = 6, 60, 8
#: Added to the curvature of a leaf, in rows' worth of it.
CALM = 2.0
THRESHOLD = 0.7

_KINDS = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "wide": [*range(128, 256)],
    "space": [9, 11, 12, 13, 32], "line": [10], "stop": [33, 46, 63], "comma": [44, 58, 59], "quote": [34, 39, 40, 41],
    "symbol": [i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "!.?,:;\"'()"],
}
MEASURES = ("words", "word_length", "upper", "digit", "wide", "stop", "comma", "quote", "symbol", "odd_words", "lines", "line_length",
            "repeated_lines", "distinct_words", "same_as_last", "top_word", "shout")


def _class_table(codes: list[int]) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[codes] = 1
    return table


_TABLES = {k: _class_table(v) for k, v in _KINDS.items()}
_UNEXPECTED = _class_table(_KINDS["symbol"] + [33])
_NOT_LINE = np.ones(256, bool)
_NOT_LINE[10] = False


def measures(column: pa.Array) -> np.ndarray:
    """One row of MEASURES per text. An empty or null text has zeros."""
    out = np.zeros((len(column), len(MEASURES)))
    for block in texts.blocks(column):
        out[block.first : block.first + len(block)] = _measures(block)
    return out


def _measures(block: texts.Block) -> np.ndarray:
    size = np.diff(block.bounds)
    count = {}
    for kind in ("upper", "digit", "wide", "stop", "comma", "quote", "symbol", "line"):
        upto = np.concatenate([[0], np.cumsum(_TABLES[kind][block.data], dtype=np.int64)])
        count[kind] = upto[block.bounds[1:]] - upto[block.bounds[:-1]]
    places = texts.words(block, texts.NOT_SPACE)
    hashes = texts.word_hashes(block, places)
    lines = texts.words(block, _NOT_LINE)
    line_hashes = texts.word_hashes(block, lines)
    upto = np.concatenate([[0], np.cumsum(_UNEXPECTED[block.data], dtype=np.int64)])
    odd = (upto[places.end] - upto[places.start]) > 0
    upper = np.concatenate([[0], np.cumsum(_TABLES["upper"][block.data], dtype=np.int64)])
    shout = (upper[places.end] - upper[places.start]) >= 2
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    inner = places.first[:-1]
    same[inner[inner < len(same)]] = False
    n = np.diff(places.first)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[places.first])
    distinct, top = np.zeros(len(block)), np.zeros(len(block))
    repeated = np.zeros(len(block))
    for i in range(len(block)):
        mine = hashes[places.first[i] : places.first[i + 1]]
        if len(mine):
            _, times = np.unique(mine, return_counts=True)
            distinct[i], top[i] = len(times), times.max()
        own = line_hashes[lines.first[i] : lines.first[i + 1]]
        if len(own) > 1:
            repeated[i] = len(own) - len(np.unique(own))
    n_lines = np.diff(lines.first)
    bytes_, words_, lines_ = np.maximum(size, 1), np.maximum(n, 1), np.maximum(n_lines, 1)
    columns = {
        "words": np.log1p(n), "word_length": size / words_, "upper": count["upper"] / bytes_, "digit": count["digit"] / bytes_,
        "wide": count["wide"] / bytes_, "stop": count["stop"] / words_, "comma": count["comma"] / words_, "quote": count["quote"] / words_,
        "symbol": count["symbol"] / words_, "odd_words": total(odd) / words_, "lines": np.log1p(n_lines), "line_length": np.log1p(n / lines_),
        "repeated_lines": repeated / lines_, "distinct_words": distinct / words_, "same_as_last": total(same) / words_,
        "top_word": top / words_, "shout": total(shout) / words_,
    }
    return np.column_stack([columns[m] for m in MEASURES])


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), int)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[bins[:, j]]
        for i, j, table in self.pairs:
            out += table[bins[:, i], bins[:, j]]
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.raw(self.bins(measures(column))))


def _step(gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    return gradient / (curvature + CALM * 0.25)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + CALM * 0.25)


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One value per bin: a tree of at most LEAVES leaves on bins in order, split where it gains most."""
    upto_g, upto_h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    leaves = [(0, len(g))]

    def split(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        at = np.arange(a + 1, b)
        left = _gain(upto_g[at] - upto_g[a], upto_h[at] - upto_h[a])
        right = _gain(upto_g[b] - upto_g[at], upto_h[b] - upto_h[at])
        gains = left + right - _gain(upto_g[b] - upto_g[a], upto_h[b] - upto_h[a])
        best = int(np.argmax(gains))
        return float(gains[best]), int(at[best])

    while len(leaves) < LEAVES:
        found = [(*split(a, b), k) for k, (a, b) in enumerate(leaves)]
        gain, at, k = max(found, key=lambda f: f[0])
        if gain <= 1e-12:
            break
        a, b = leaves[k]
        leaves[k : k + 1] = [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = _step(upto_g[b] - upto_g[a], upto_h[b] - upto_h[a])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best split of two measures into four quadrants: its gain, and one value per pair of bins."""
    ug, uh = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    a, b = ug.shape[0] - 1, ug.shape[1] - 1
    i, j = np.arange(1, a)[:, None], np.arange(1, b)[None, :]
    parts = [[u[i, j], u[i, b] - u[i, j], u[a, j] - u[i, j], u[a, b] - u[i, b] - u[a, j] + u[i, j]] for u in (ug, uh)]
    gains = sum(_gain(x, y) for x, y in zip(*parts))
    if not gains.size:
        return 0.0, np.zeros_like(g)
    at = np.unravel_index(np.argmax(gains), gains.shape)
    values = [float(_step(x[at], y[at])) for x, y in zip(*parts)]
    out = np.empty_like(g)
    x, y = at[0] + 1, at[1] + 1
    out[:x, :y], out[:x, y:], out[x:, :y], out[x:, y:] = values
    return float(gains[at]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts the tables on the rows of measures ``x`` with labels ``y`` (0 or 1)."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1e-6
    model = Model(float(np.log(share / (1 - share))))
    if not 0 < share < 1 or len(set(y.tolist())) < 2:
        return Model(20.0 if share > 0.5 else -20.0)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = model.bins(x)
    raw = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = sigmoid(raw)
            g = np.bincount(bins[:, j], y - p, len(table))
            h = np.bincount(bins[:, j], p * (1 - p), len(table))
            step = RATE * _shallow_tree(g, h)
            table += step
            raw += step[bins[:, j]]
    coarse = [np.minimum(np.arange(len(t)) * COARSE // len(t), COARSE - 1) for t in model.tables]
    p = sigmoid(raw)

    def joint(i: int, j: int, p: np.ndarray, fine: bool) -> tuple[np.ndarray, np.ndarray]:
        a, b = (bins[:, i], bins[:, j]) if fine else (coarse[i][bins[:, i]], coarse[j][bins[:, j]])
        shape = (len(model.tables[i]), len(model.tables[j])) if fine else (COARSE, COARSE)
        at = a * shape[1] + b
        size = shape[0] * shape[1]
        return np.bincount(at, y - p, size).reshape(shape), np.bincount(at, p * (1 - p), size).reshape(shape)

    n = len(model.tables)
    gains = sorted(((_quadrants(*joint(i, j, p, False))[0], i, j) for i in range(n) for j in range(i + 1, n)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for gain, i, j in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * _quadrants(*joint(i, j, sigmoid(raw), True))[1]
            table += step
            raw += step[bins[:, i], bins[:, j]]
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = measures(batch.column("text"))
        yield pa.RecordBatch.from_pydict({"label": batch.column("label").cast(pa.int32()), "x": pa.array([r.tobytes() for r in rows], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from ``labels(doc_id, quality)`` of rows that are not held out. Without labels of both kinds the score is near 0 or 1."""
    rows = labelled(docs, labels, "quality", sample).mapInArrow(_measured, "label int, x binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float64).reshape(len(rows), len(MEASURES))
    return fit(x, np.array([r["label"] for r in rows], np.float64))


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The probability that a text is of good quality, as a column. Null and empty texts are scored by their measures, all 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def good(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(column))

    return good(docs[text])
