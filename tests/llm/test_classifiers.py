import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leasemill.llm import langid, ngrams, quality, toxicity
from leasemill.llm.training import held_out

SF = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    got = {r["i"]: r["h"] for r in spark.range(200).select(F.col("id").alias("i"), held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS i").select(held_out(F.col("i"))).first()[0] is False


def test_grams_of_long_texts_count_once(monkeypatch):
    text = "".join(random.Random(1).choices("abc ", k=3000))

    def grams():
        return sorted(h for b in ngrams.blocks(pa.array([None, text, ""]), 6) for n in (3, 6) for h in b.hashes(n)[0].tolist())

    whole = grams()
    monkeypatch.setattr(ngrams, "LIMIT", 100)
    assert grams() == whole and len(whole) == 2998 + 2995


def scored(frame, labels, label, threshold):
    rows = frame.join(labels, "doc_id").where(f"held_out AND {label} IS NOT NULL").collect()
    return np.mean([(r["score"] >= threshold) == bool(r[label]) for r in rows])


@pytest.mark.parametrize("module, label, least", [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = module.train(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), module.score(docs, model).alias("score"))
    assert scored(out, labels, label, module.THRESHOLD) >= least


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_few_labels_and_odd_texts(spark, documents, module, label):
    pairs = [(0, None), (1, ""), (2, "x" * 300_000), (3, "good"), (3, "good"), (None, "bad")]
    docs = documents(pairs, "label")
    for rows in ([], [(3, 1)], [(3, 0), (None, 1)], [(3, None), (0, 1), (1, 0), (3, 1)]):
        labels = spark.createDataFrame(rows, f"doc_id long, {label} int")
        scores = [r[0] for r in docs.select(module.score(docs, module.train(docs, labels))).collect()]
        assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    empty = documents([])
    assert empty.select(module.score(empty, module.train(empty, labels))).count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs.select("lang", held_out(F.col("doc_id")).alias("h"), langid.identify(docs, langid.train(docs)).alias("f"))
    rows = out.where("h").collect()
    assert np.mean([r["f"]["lang"] == r["lang"] for r in rows]) > 0.97 and all(0 <= r["f"]["score"] <= 1 for r in rows)


def test_languages_of_odd_texts(spark, documents):
    docs = documents([(0, None), (1, "12 !"), (3, "abc abd"), (4, "abc"), (5, "y" * 400_000)])
    found = {r[0]: r[1] for r in docs.select("doc_id", langid.identify(docs, langid.train(docs))).collect()}
    assert found[0]["lang"] == found[1]["lang"] == "und" and found[3]["lang"] == "en"
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r[0]["lang"] for r in unknown.select(langid.identify(unknown, langid.train(unknown))).collect()} == {"und"}
    empty = documents([])
    assert empty.select(langid.identify(empty, langid.train(empty))).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 8, 30):
        code = langid.codewords(n)
        apart = (code[:, None] != code[None]).sum(2)[~np.eye(n, dtype=bool)]
        assert apart.min() >= (1 if n == 2 else 2) and code.any(0).all() and not code.all(0).any()
    wrong = langid.Model(["a", "b", "c", "d"], langid.codewords(4), bit_weights=np.ones(7))
    margins = np.where(wrong.code[2] == 1, 3.0, -3.0)[None, :].copy()
    margins[0, 1] *= -1  # one bit in error is put right
    assert wrong.decode(margins)[0][0] == 2 and not wrong.decode(margins)[2][0] and wrong.decode(np.zeros((1, 7)))[2][0]


def test_pairs_are_learnt():
    rng = np.random.Generator(np.random.PCG64(3))
    x = rng.random((4000, len(quality.MEASURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert {(i, j) for i, j, _ in model.pairs} >= {(0, 1)}
    assert np.mean((model.raw(model.bins(x)) > 0) == y) > 0.95
