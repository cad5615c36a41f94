"""The stages of the pipeline against brute force, each on its own input."""

import re

import brute
import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_toxic_documents_go(spark, docs):
    kept = P.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(ids(docs)) - set(ids(kept))
    assert sum(labels.get(i, 1) for i in gone) >= 0.8 * len(gone) and sum(labels.get(i, 0) for i in ids(kept)) <= 2


def test_copies_go(spark, docs):
    kept = P.drop_copies(spark, docs, SF)
    best = {}
    for i, t in pairs(docs):
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (0, float("inf"))), (-len(t or ""), i))
    assert kept.columns == docs.columns and ids(kept) == sorted(i for _, i in best.values())


def test_near_copies_go(spark, docs):
    kept = P.drop_near_copies(spark, docs, SF)
    expected = brute.near_components(pairs(docs), 5, 80)
    assert kept.columns == docs.columns and ids(kept) == sorted(i for i, (_, c) in expected.items() if i == c)


def test_contaminated_documents_go(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = brute.contamination(pairs(docs), items)
    assert ids(P.drop_contaminated(spark, docs, SF)) == sorted(i for i, (_, hit, _) in expected.items() if not hit)


def test_rows_without_ids_and_repeated_rows(spark, documents):
    docs = documents([(1, "a b"), (1, "a b"), (1, "ab"), (None, None), (None, ""), (2, "c d e f g h i"), (2, "c d e f g h i")], "digest")
    assert sorted((i or 0, t) for i, t in pairs(P.drop_copies(spark, docs, SF)) if t) == [(1, "a b"), (2, "c d e f g h i")]
    assert P.drop_copies(spark, docs, SF).count() == 3
    near = P.drop_near_copies(spark, docs, SF)
    assert near.count() == 5 and near.columns == docs.columns
    none = documents([])
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_whole_run(spark, docs):
    rows = P.run(spark, SF).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(ids(docs))
    room = {}
    for r in rows:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert max(room.values()) <= 1024
