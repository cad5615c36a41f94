"""MinHash near-duplicates by HyperMinHash signatures, with exact confirmation.

A text's set holds its distinct shingles of ``width`` consecutive lower-cased (A-Z) words; a text of fewer words is one
shingle, a text without words or a null text has an empty set and is linked with nothing. Two texts are linked where their
sets' Jaccard similarity reaches ``percent``.

1. Equal sets become one *node* (a digest of the set). Copies, however many, cost one row each.
2. Every node gets a HyperMinHash signature: ``REGISTERS`` buckets, each holding the leading-zero count and the first
   ``MANTISSA`` bits after it of the bucket's smallest hash, 16 bits in all. Empty buckets borrow from others in a fixed
   order per bucket, so small sets have full signatures too.
3. ``BANDS`` bands of ``ROWS`` compressed registers make candidate groups. A pair at similarity 0.8 shares no band with
   probability (1 - 0.8**6)**48 = 5e-7.
4. Within a group only the pairs with its hub, the node that meets most others over all bands, are looked at. The
   collision-corrected estimate of the similarity, from whole signatures, discards pairs ``SLACK`` (6 standard deviations) below the
   threshold; the rest is confirmed on the full sets.
5. Linked nodes are merged. Bands that still hold several components are settled without emitting their pairs. The nodes
   outside the component of a band's hub meet each other and the rest of the band in cells of two blocks. Every pair of different
   components is looked at in the first band that it shares, by the order of the band keys, and there only: on signatures
   first; then the nodes that have a pair left by the estimate meet again with their full sets. A task emits links that
   join components it hasn't joined yet, at most one per node. Of bands with the same nodes one is taken. Pairs with the hub are those of step 4.
6. Components of all links; the smallest doc_id of each names it.

Rows with the same doc_id are separate documents. Null doc_ids take part; a component without any other id has a null
component_id and keeps its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasemill.llm import groups, texts
from leasemill.llm.graph import components
from leasemill.llm.store import stored

ROWS, BANDS, MANTISSA = 6, 48, 10
REGISTERS = ROWS * BANDS
SLACK = 0.15
#: Nodes of a block in step 5, about: a cell holds two blocks.
BLOCK_NODES = 256
_SALT = np.uint64(0x5851F42D4C957F2D)


def _probes() -> np.ndarray:
    """For each bucket the order in which it looks for a filled one, itself first."""
    order = np.random.Generator(np.random.PCG64(7)).permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1)
    own = np.arange(REGISTERS)[:, None]
    rest = order[order != own].reshape(REGISTERS, REGISTERS - 1)
    return np.hstack([own, rest])


PROBES = _probes()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (uint16), one row per non-empty set."""
    if not sets:
        return np.zeros((0, REGISTERS), np.uint16)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    bucket = ((values >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    hashed = texts.mix(values ^ _SALT)
    least = np.full(len(sets) * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owner * REGISTERS + bucket.astype(np.int64), hashed)
    least = least.reshape(len(sets), REGISTERS)
    filled = least != np.iinfo(np.uint64).max
    row, col = np.nonzero(~filled)
    out = least.copy()
    for j in range(1, REGISTERS):
        if not len(row):
            break
        source = PROBES[col, j]
        found = filled[row, source]
        out[row[found], col[found]] = least[row[found], source[found]]
        row, col = row[~found], col[~found]
    # A double keeps just this: the exponent is the leading-zero count, and the mantissa's first bits follow it.
    bits = (out | np.uint64(1)).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
    zeros = np.uint64(1087) - (bits >> np.uint64(MANTISSA))
    return ((zeros << np.uint64(MANTISSA)) | (bits & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of compressed registers."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = texts.mix(key * np.uint64(texts.BASE) + parts[:, :, j])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from register matches, less the matches expected of different minima.

    Two different minima agree if their leading-zero counts agree (1/3 over all counts) and their mantissas do (2**-bits).
    """
    chance = 2.0**-MANTISSA / 3
    share = (a == b).mean(axis=1)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _set_rows(width: int, payload: str):
    """Maps (doc_id, text) to (doc_id, node, n_shingles, payload); payload is the signature or the set itself."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in texts.blocks(batch.column(1)):
                places = texts.words(block, texts.NOT_SPACE)
                sets = texts.shingle_sets(block, places, texts.word_hashes(block, places), width)
                full = [s for s in sets if len(s)]
                if payload == "signature":
                    data = [r.tobytes() for r in signatures(full)]
                else:
                    data = [s.tobytes() for s in full]
                data = iter(data)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(block.first, len(block)),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(data) if len(s) else None for s in sets], pa.binary()),
                ], names=["doc_id", "node", "n_shingles", payload])

    return rows


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        for at in range(0, len(batch), 2048):
            keys = band_keys(registers[at : at + 2048])
            node = batch.column(0).slice(at, len(keys)).take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), node], names=["band", "node"])


def _near_by_signature(percent: int):
    least = percent / 100 - SLACK

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
                near = pa.array(estimate(a, b) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return rows


def _linked(percent: int):
    """Keeps the pairs whose full sets reach the similarity."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return rows


def first_pairs(rows: pd.DataFrame, registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row numbers) of a cell that lie in different components and share no band with a smaller key than the cell's."""
    cell = rows.groupby(["band", "r", "c"], sort=False).ngroup().to_numpy()
    own, block = pd.factorize(rows["own"])[0], rows["block"].to_numpy()
    met = np.tri(len(rows), k=-1, dtype=bool) & (cell[:, None] == cell) & (own[:, None] != own)
    met &= (block[:, None] != block) | (rows["r"].to_numpy() == rows["c"].to_numpy())
    a, b = np.nonzero(met)
    keys, band = band_keys(registers), rows["band"].to_numpy()
    for j in range(BANDS):
        x = keys[a, j]
        first = (x != keys[b, j]) | (x >= band[a])
        a, b = a[first], b[first]
    return a, b


def _candidates(cells: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the first pairs that the estimate leaves."""
    registers = np.frombuffer(b"".join(cells["signature"]), np.uint16).reshape(-1, REGISTERS)
    a, b = first_pairs(cells, registers)
    near = [estimate(registers[a[at : at + 4096]], registers[b[at : at + 4096]]) for at in range(0, len(a), 4096)]
    near = np.concatenate([np.zeros(0), *near]) >= percent / 100 - SLACK
    return a[near], b[near]


def _open_rows(percent: int):
    """The rows of cells that have a pair left by the estimate."""

    def rows(cells: pd.DataFrame) -> pd.DataFrame:
        met = np.unique(np.concatenate(_candidates(cells, percent)))
        return cells.iloc[met][_CELL_COLUMNS]

    return rows


def _cell_links(percent: int):
    """Links that join the components of cells, on full sets."""

    def rows(cells: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in cells["shingles"]]
        to = list(range(len(sets)))
        own = pd.factorize(cells["own"])[0].tolist()

        def root(x: int) -> int:
            while to[x] != x:
                to[x] = to[to[x]]
                x = to[x]
            return x

        links = []
        for i, j in zip(*(x.tolist() for x in _candidates(cells, percent))):
            x, y = root(own[i]), root(own[j])
            if x == y:
                continue
            few, many = sorted((sets[i], sets[j]), key=len)
            if 100 * len(few) < percent * len(many):
                continue
            both = np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few)
            if 100 * both >= percent * (len(few) + len(many) - both):
                links.append((i, j))
                to[x] = y
        node = cells["node"].to_numpy()
        return pd.DataFrame({"a": [node[i] for i, _ in links], "b": [node[j] for _, j in links]})

    return rows


_CELL = "share long, band long, r int, c int, node binary, own binary, block int"
_CELL_COLUMNS = ["share", "band", "r", "c", "node", "own", "block"]
_PAIRS = "a binary, b binary"


def shingle_nodes(docs: DataFrame, width: int) -> DataFrame:
    """Step 1 and 2: one row per document with its node, set size and signature, as a stored table."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, n_shingles long, signature binary"
    return stored(docs.select("doc_id", "text").mapInArrow(_set_rows(width, "signature"), schema), "signatures")


def _with_hub(bands_of: DataFrame) -> DataFrame:
    """Each (band, node) with the band's hub and size; bands of one node are gone."""
    sizes = bands_of.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    bands_of = stored(bands_of.join(sizes, "band"), "bands")
    meets = bands_of.groupBy("node").agg(F.sum("size").alias("meets"))
    bands_of = bands_of.join(meets, "node")
    hubs = bands_of.groupBy("band").agg(F.max(F.struct("meets", "node"))["node"].alias("hub"))
    return stored(bands_of.join(hubs, "band").select("band", "node", "hub", "size"), "hubs")


def links_between(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Steps 3 to 5: links (a, b) that join exactly the nodes which links of similarity ``percent`` or more join."""
    distinct = nodes.where("node is not null").groupBy("node").agg(F.first("signature").alias("signature"))
    distinct = stored(distinct, "distinct")
    bands_of = _with_hub(distinct.mapInArrow(_band_rows, "band long, node binary"))

    met = bands_of.select("node").distinct()
    ids = nodes.join(met, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts_met = docs.select("doc_id", "text").alias("d").join(ids.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, n_shingles long, shingles binary"
    sets = texts_met.mapInArrow(_set_rows(width, "shingles"), schema).where("node is not null")
    sets = stored(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    pairs = bands_of.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    near = _joined(pairs, distinct, "signature").mapInArrow(_near_by_signature(percent), _PAIRS)
    stars = stored(_joined(near, sets, "shingles").mapInArrow(_linked(percent), _PAIRS), "stars")

    roots = stored(components(stars), "roots")
    met = cells(bands_of, roots, distinct).groupBy("share").applyInPandas(_open_rows(percent), _CELL)
    met = stored(met, "met").join(distinct.select("node", "signature"), "node").join(sets, "node")
    more = stored(met.groupBy("share").applyInPandas(_cell_links(percent), _PAIRS), "more")
    return stars.union(more)


def cells(bands_of: DataFrame, roots: DataFrame, signatures: DataFrame) -> DataFrame:
    """Step 5's cells (band, r, c): rows (share, ..., node, own, block, signature) of blocks r and c of a band.

    Blocks are numbered from 0, those of nodes outside the hub's component first. An outside block meets every block of its
    band once, itself too; two blocks of the hub's component don't meet. A share is a number of whole cells, about two blocks
    of rows; most bands are small.
    """
    large = _rooted(_rooted(bands_of.where("size > 2"), roots, "node", "own"), roots, "hub", "home")
    large = stored(large.where("node <> hub").select("band", "node", "own", (F.col("own") != F.col("home")).alias("outside")), "unsettled")
    bands = large.groupBy("band").agg(
        F.count_if("outside").alias("n_outside"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("z"))
    bands = bands.where("n_outside > 0").groupBy("n", "n_outside", "x", "y", "z").agg(F.min("band").alias("band"))
    parts = lambda n: F.ceil(n / BLOCK_NODES).cast("int")
    first, rest = parts(F.col("n_outside")), parts(F.col("n") - F.col("n_outside"))
    n_rows = F.col("n_outside") * (first + rest) + (F.col("n") - F.col("n_outside")) * first
    bands = stored(bands.select("band", first.alias("first"), rest.alias("rest"), n_rows.alias("n_rows")), "open-bands")
    shares = max(1, (bands.agg(F.sum("n_rows")).first()[0] or 0) // (2 * BLOCK_NODES))
    place = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")
    block = F.when(F.col("outside"), place("first")).otherwise(F.col("first") + place("rest"))
    meets = F.when(F.col("outside"), F.col("first") + F.col("rest")).otherwise(F.col("first"))
    rows = large.join(bands, "band").select("band", "node", "own", block.alias("block"), meets.alias("meets"))
    rows = rows.join(signatures.select("node", "signature"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    rows = rows.withColumns({"r": F.least("block", "other"), "c": F.greatest("block", "other")})
    share = F.pmod(F.xxhash64("band", "r", "c"), F.lit(shares))
    return rows.select(share.alias("share"), "band", "r", "c", "node", "own", "block", "signature")


def _joined(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    left = values.select(F.col("node").alias("a"), F.col(column).alias("x"))
    right = values.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def _rooted(df: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    to = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return df.join(to, node, "left").withColumn(name, F.coalesce("_root", node)).drop("_root")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id, kept.

    Other columns of docs are not looked at. No rows give no rows.
    """
    nodes = shingle_nodes(docs, width)
    roots = stored(components(links_between(docs, nodes, width, percent)), "roots")
    named = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = stored(_rooted(named, roots, "node", "root"), "named")
    component = stored(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "components")
    named = groups.joined(named, component, "root").select("node", "component_id")
    out = nodes.select("doc_id", "node", "n_shingles").join(named, "node", "left")
    component_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component_id).alias("kept"))
