"""The registered queries on the smallest tables: against their SQL, or against brute force."""

import hashlib

import brute
import pytest
from compare import connect, differences

import __spark_entry__ as driver
from leasemill.llm import chat, queries

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(driver.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)} and set(queries.queries()) | {"pipeline"} <= names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) is None


def test_near_duplicates(spark):
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op5_minhash_near_dedup(spark, SF).collect()}
    assert got == brute.near_components(pairs, 2, 80)


def test_conversations(spark):
    expected = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        expected.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    expected[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    rows = {r["conv_id"]: r for r in queries.op6_chat_formatting(spark, SF).collect()}
    assert rows.keys() == expected.keys()
    for i, turns in expected.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert rows[i]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (rows[i]["loss_chars"], rows[i]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert rows[i]["formatted_chars"] == len(chat.format_turns(turns)[0])


@pytest.mark.parametrize("name", ["op2_license_scans", "op4_toxicity", "op7_language_id", "op8_pii", "op10_quality_classifier"])
def test_one_row_per_document(spark, name):
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in queries.queries()[name](spark, SF).select("doc_id").collect()) == ids
