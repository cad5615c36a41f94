import hashlib
import math
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from leasemill.llm import importance as I, texts


def runs(text):
    w = brute.words(text)
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def expected(docs, target):
    """doc_id -> (n_features, weight, score, rank), for distinct ids."""
    def counts(all_texts):
        n = [0] * 10_000
        for t in all_texts:
            for f in runs(t)[1]:
                n[zlib.crc32(f.encode()) % 10_000] += 1
        return n

    s, t = counts([x for _, x in docs]), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out, enough = {}, []
    for i, text in docs:
        words, features = runs(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in features)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = (len(features), weight, score, None)
        if len(words) >= 20:
            enough.append((-score, i))
    for k, (_, i) in enumerate(sorted(enough)[: 5 * len(enough) // 100]):
        out[i] = (*out[i][:3], k + 1)
    return out


def case():
    rng = random.Random(8)
    words = ["a", "Bb", "été", "x1", "日本", "the", "z" * 70, "y" * 5000]
    docs = [(i, rng.choice([" ", ", ", "\n", "\x01"]).join(rng.choices(words, k=rng.randrange(60)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, " .,"), (1003, "one"), (1004, "Ab" * 300_000), (1005, "q r s " * 40_000)]
    return docs, ["the été a Bb " * 8, None, "日本 x1", ""]


def frames(spark, documents, docs, target):
    return documents(docs, "rank"), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")


def test_equals_brute_force(spark, documents):
    docs, target = case()
    got = {r["doc_id"]: tuple(r)[1:] for r in I.digest(*frames(spark, documents, docs, target)).collect()}
    assert got == expected(docs, target)


@pytest.mark.parametrize("piece", [8, 64, 1000])
def test_pieces_do_not_change_the_features(monkeypatch, piece):
    monkeypatch.setattr(I, "PIECE", piece)
    column = pa.array([t for _, t in case()[0] if t is None or len(t) < 20_000])
    for block in texts.blocks(column, 5000):
        found = I.payloads(block)
        mine = [brute.words(block.text(i).decode()) for i in range(len(block))]
        assert found.tolist() == [x for w in mine for x in [*(zlib.crc32(s.encode()) | len(s.encode()) << 32 for s in w), 0]]


def test_crc_of_joined_bytes():
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randrange(20)), rng.randbytes(n)) for n in [0, 1, 2, 63, 64, 65, 127, 1000, 70_000]]
    got = I.carried(np.array([zlib.crc32(a) for a, _ in pairs], np.uint32), np.array([len(b) for _, b in pairs]))
    assert (got ^ np.array([zlib.crc32(b) for _, b in pairs], np.uint32)).tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_repeated_rows_and_null_ids(spark, documents):
    text = "w " * 30
    docs = [(7, text)] * 50 + [(None, text)] * 30 + [(8, "x " * 25)] * 20
    df = documents(docs, "rank")
    target = spark.createDataFrame([("x x x",)], "text string")
    found = I.digest(df, target).collect()
    assert len(found) == 100 and sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3, 4, 5]
    drawn = I.resampled(df, target)
    assert drawn.columns == df.columns and [r["doc_id"] for r in drawn.collect()] == [8]


def test_nothing_to_draw(spark, documents):
    nothing = spark.createDataFrame([], "text string")
    assert I.digest(documents([]), nothing).count() == 0
    assert [r["rank"] for r in I.digest(documents([(1, "a " * 30)]), nothing).collect()] == [None]
