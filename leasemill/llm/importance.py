"""Target-distribution importance resampling on hashed word n-grams, counted through an Aho-Corasick dictionary.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Features are all runs of 1 to 3 consecutive words,
joined by one blank; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``BUCKETS``.

The dictionary of a piece of text is one automaton of its distinct words, each with a delimiter on both sides. A word's payload is
the CRC of its bytes and their number, so every word is hashed once however often it occurs. One scan of the piece emits the payloads
in text order, and a mark at the end of each text. The CRC of a longer feature is put together from adjacent payloads alone: the CRC of
A followed by B is that of A, carried over as many zero bytes as B has, xor that of B. No feature's text is ever made.

Pieces hold ``PIECE`` bytes or one word, cut between words and never between payloads, so memory follows the piece and features
still cross its edges. A word longer than ``LONG`` bytes stands in the scanned text as a number, with the payload of the word.

Documents are counted in one pass and scored in another; a task sends at most ``BUCKETS`` sums. Ranks come from rows dealt by ranges
of score, numbered within each range.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leasemill.llm import rows, texts
from leasemill.llm.store import stored

BUCKETS = 10_000
RUN = 3
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
PIECE = 1 << 19
LONG = 1 << 12

_LOWER = bytes(texts._LOWER.astype(np.uint8))
#: Lower-cased word bytes; every other byte is a blank.
_PLAIN = bytes(c if texts.ALPHANUMERIC[i] else 32 for i, c in enumerate(_LOWER))
_TOO_LONG = re.compile(rb"[^ \n]{%d,}" % (LONG + 1))


def _after_one(crc: np.ndarray) -> np.ndarray:
    """CRC registers carried over one zero byte."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    return (crc >> np.uint32(8)) ^ byte[crc & np.uint32(255)]


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The linear map of a (4, 256) table; ``table`` may also hold one such table per element."""
    parts = [(crc >> np.uint32(8 * j)) & np.uint32(255) for j in range(4)]
    if table.ndim == 2:
        return table[0][parts[0]] ^ table[1][parts[1]] ^ table[2][parts[2]] ^ table[3][parts[3]]
    at = np.arange(len(crc))
    return table[at, 0, parts[0]] ^ table[at, 1, parts[1]] ^ table[at, 2, parts[2]] ^ table[at, 3, parts[3]]


#: Carrying over 0 to 63 zero bytes, and over 2**j for longer ones.
_SHORT = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    unit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    short = [unit]
    for _ in range(_SHORT - 1):
        short.append(_after_one(short[-1]))
    doubled = [short[1]]
    for _ in range(31):
        doubled.append(_apply(doubled[-1], doubled[-1]))
    return np.stack(short), np.stack(doubled)


_BY_LENGTH, _BY_POWER = _tables()
_FLAT = _BY_LENGTH.reshape(-1)


def carried(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs carried over ``length`` zero bytes each."""
    short = np.minimum(length, _SHORT - 1).astype(np.int64) * 1024
    out = _FLAT[short + (crc & 255)] ^ _FLAT[short + 256 + ((crc >> 8) & 255)] ^ _FLAT[short + 512 + ((crc >> 16) & 255)] ^ _FLAT[short + 768 + (crc >> 24)]
    far = np.flatnonzero(length >= _SHORT)
    if len(far):
        value = crc[far]
        for j in range(int(length[far].max()).bit_length()):
            on = ((length[far] >> j) & 1).astype(bool)
            value[on] = _apply(_BY_POWER[j], value[on])
        out[far] = value
    return out


def _pieces(data: bytes) -> Iterator[bytes]:
    """The data in pieces that begin and end with a blank; a blank between two pieces belongs to both."""
    at = 0
    while at < len(data) - 1:
        to = data.rfind(b" ", at + 1, at + PIECE) if at + PIECE < len(data) else len(data) - 1
        if to < 0:
            to = data.find(b" ", at + 1)
        yield data[at : to + 1]
        at = to


def payloads(block: texts.Block) -> np.ndarray:
    """CRC + 2**32 * length of every word of the block's texts in order, 0 after each text."""
    plain, cut = block.data.tobytes().translate(_PLAIN), block.bounds.tolist()
    data = b" " + b" \n ".join([plain[a:b] for a, b in zip(cut, cut[1:])]) + b" \n "
    out = []
    for piece in _pieces(data):
        # Numbers of long words: byte 1 never occurs in a word.
        long: dict[bytes, bytes] = {}
        piece = _TOO_LONG.sub(lambda m: long.setdefault(m.group(), b"\x01%d" % len(long)), piece)
        standing = {name: word for word, name in long.items()}
        dictionary, carries = ahocorasick.Automaton(ahocorasick.STORE_INTS), [0]
        dictionary.add_word(" \n ", 0)
        for name in set(piece.split(b" ")) - {b"", b"\n"}:
            word = standing.get(name, name)
            # The automaton's own numbers have 32 bits: it emits places in the list of payloads.
            dictionary.add_word(f" {name.decode('latin-1')} ", len(carries))
            carries.append(zlib.crc32(word) | len(word) << 32)
        dictionary.make_automaton()
        emitted = np.fromiter((p for _, p in dictionary.iter(piece.decode("latin-1"))), np.int64)
        out.append(np.array(carries, np.int64)[emitted])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_BLANK = np.uint32(zlib.crc32(b" "))


def features(emitted: np.ndarray, buckets: int, run: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words per text, and for each length of feature (text, bucket) of all its features."""
    mark = emitted == 0
    word = emitted[~mark]
    text = (np.cumsum(mark) - mark)[~mark]
    crc, length = (word & 0xFFFFFFFF).astype(np.uint32), word >> 32
    out, joined = [], crc
    for n in range(run):
        if n:
            # All runs of n words and a blank, carried over the word that follows.
            joined = carried(carried(joined[:-1], np.ones(max(0, len(joined) - 1), np.int64)) ^ _BLANK, length[n:]) ^ crc[n:]
        within = text[: len(joined)] == text[n:]
        out.append((text[n:][within], (joined[within] % np.uint32(buckets)).astype(np.int64)))
    return np.bincount(text, minlength=int(mark.sum())), out


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How many features of all texts fall into each bucket. Null texts have none."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in texts.blocks(batch.column(0), PIECE):
                for _, found in features(payloads(block), buckets, run)[1]:
                    n += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["bucket", "n"])

    by_task = df.select(text).mapInArrow(counted, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in by_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier each bucket is in the target than in the source, both smoothed by one."""
    k = len(source)
    s, t, all_s, all_t = source.astype(float), target.astype(float), float(source.sum()), float(target.sum())
    return np.floor(1000 * np.log((t + 1) * (all_s + k) / ((s + 1) * (all_t + k)))).astype(np.int64)


def weighed(text: Column, gain: np.ndarray, run: int = RUN) -> Column:
    """struct(n_words, n_features, weight): the sum of the gains of a text's features, 0 without any. Null texts have no words."""
    value = gain.astype(float)

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def weigh(column: pa.Array) -> pa.Array:
        n_words, n_features, weight = (np.zeros(len(column), np.int64) for _ in range(3))
        for block in texts.blocks(column, PIECE):
            here = slice(block.first, block.first + len(block))
            n_words[here], found = features(payloads(block), len(value), run)
            for owner, bucket in found:
                n_features[here] += np.bincount(owner, minlength=len(block))
                # Sums of whole numbers, exact in doubles.
                weight[here] += np.bincount(owner, value[bucket], len(block)).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_features), pa.array(weight)], ["n_words", "n_features", "weight"])

    return weigh(text)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) from a hash of seed and id; a null id counts as the empty string."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... by falling score among the floor(percent * N / 100) drawn of its N rows with enough words, else null.

    Ties go to the smaller doc_id (null last), then to the earlier ``row``, the unique number of each row. ``scored`` is a table.
    """
    enough = F.col("n_words") >= least_words
    n = scored.where(enough).count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    dealt = scored.where(enough).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range of the shuffle.
    first = dealt.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    place = F.col("first") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    drawn = dealt.join(F.broadcast(first), "range").withColumn("place", place)
    drawn = drawn.withColumn("rank", F.when(F.col("place") <= n * percent // 100, F.col("place")).cast("long"))
    return drawn.select(*scored.columns, "rank").union(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def scores(docs: DataFrame, target: DataFrame, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank and the carried columns, one row per row of ``docs(doc_id, text, ...)``.

    ``target(text, ...)`` holds the texts whose distribution is wanted; without any word there, or none in docs, the smoothing alone
    decides. Null and empty texts have no features and weight 0; repeated rows are rows of their own; an empty table gives none.
    Ids of any type are kept; other columns are not looked at.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    found = docs.select("doc_id", *carry, weighed(F.col("text"), gain).alias("f")).select("doc_id", *carry, "f.*")
    found = found.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "row": F.monotonically_increasing_id()})
    return ranked(stored(found, "scores")).drop("row")


def resampled(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """The drawn rows of docs, whole. Rows of equal id and text are drawn together and kept once."""
    keyed = rows.with_keys(docs)
    drawn = scores(keyed, target, seed, carry=rows.KEYS).where("rank is not null")
    return rows.only_once(keyed, stored(drawn.groupBy(*rows.KEYS).agg(F.count("*").alias("n")), "drawn"))


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank, one row per row of docs."""
    return scores(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
