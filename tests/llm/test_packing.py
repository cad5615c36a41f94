import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from leasemill.llm import packing, queries

FILES = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
ODD = ["", " ", "  a  b ", "a\n b\t c", "don't <|endoftext|> 12  34", " lead", "trail ", "x  y  z\x1c q", "日本 語 ß é", "a " * 500, "\n\n \n", "zq" * 3000]


def reference():
    tokenizer = Tokenizer.from_file(FILES[0])
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("files", [FILES, (FILES[0], None, None)])
def test_encoder_equals_tokenizer(files):
    rng = random.Random(2)
    alphabet = "abc dé\n .,'12\t　s"
    many = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)]
    encoder, encode = packing.Encoder(*files), reference()
    assert [np.frombuffer(x, np.uint32).tolist() for x in encoder.many(many)] == [encode(t) for t in many]


ADDED = ["one<|endoftext|>two", "<|endoftext|>", "a <|endoftext|> b", "  <|endoftext|>  z ", "<|endoftext|><|endoftext|> q", "<|endof <|endoftext|>text|>", "<|endoftext|", "é<|endoftext|>\n日本"]


@pytest.mark.parametrize("files", [FILES, (FILES[0], None, None)])
def test_added_tokens_have_their_ids(files):
    encoder, tokenizer = packing.Encoder(*files, added_tokens=True), Tokenizer.from_file(FILES[0])
    many = [*ADDED, *ODD, *ADDED]
    assert [np.frombuffer(x, np.uint32).tolist() for x in encoder.many(many)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in many]


def test_query_and_stage_give_added_tokens_their_ids(spark, documents, tmp_path):
    tokenizer = Tokenizer.from_file(FILES[0])
    docs = documents(list(enumerate(ADDED)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    expected = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(ADDED)}
    for rows in (queries.op1_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in rows.collect()}
        assert got == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in expected.items()}


def test_added_tokens_with_options_are_refused(tmp_path):
    token = {"id": 7, "content": "<x>", "single_word": False, "lstrip": True, "rstrip": False, "normalized": False}
    (tmp_path / "v.json").write_text(json.dumps({"added_tokens": [token], "normalizer": None}))
    with pytest.raises(ValueError):
        packing.Encoder(str(tmp_path / "v.json"), *FILES[1:], added_tokens=True)


def test_plan_uses_every_piece_once():
    rng = random.Random(4)
    for size, kinds in ((10, 10), (1024, 300)):
        counts = {n: rng.randrange(1, 60) for n in rng.sample(range(1, size + 1), kinds)}
        bins = packing.plan_bins(counts, size)
        used = {}
        for lengths, times in bins:
            assert sum(lengths) <= size and times > 0
            for n in lengths:
                used[n] = used.get(n, 0) + times
        assert used == counts
        total = sum(n * k for n, k in counts.items())
        assert sum(times for _, times in bins) <= 1.25 * total / size + 2


def test_two_replace_the_smallest():
    # Greedy takes 6 and 3, one short; 3 gives way to 2 + 2, which fill the bin.
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == ((6, 2, 2), 1)


def check(spark, docs, pairs):
    encode = reference()
    expected = {i: [*encode(t), packing.END_ID] for i, t in pairs}
    rows = packing.packed(docs, *FILES).collect()
    placed = {}
    for r in rows:
        ids = expected[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] <= 1024 and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, expected.values()))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for i, ids in expected.items():
        own = sorted(r["piece"] for r in rows if r["doc_id"] == i)
        assert own == list(range(-(-len(ids) // 1024)))
    return len(placed), -(-sum(map(len, expected.values())) // 1024)


def test_packed(spark, documents):
    pairs = list(enumerate([*ODD, None, "word " * 5000]))
    check(spark, documents(pairs, "length"), pairs)
    assert packing.packed(documents([]), *FILES).count() == 0
    twice = packing.packed(documents([(1, "same"), (1, "same"), (None, "n")]), *FILES).collect()
    assert len(twice) == 3 and len({r["sequence_id"] for r in twice}) == 1


def test_nearly_full_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sequences, bound = check(spark, docs, pairs)
    assert sequences <= 1.03 * bound + 1


def test_sequences_hold_the_ids(documents):
    pairs = list(enumerate(["alpha beta", "gamma " * 1500, "delta"]))
    cut = packing.pieces(documents(pairs), *FILES)
    placed = packing.place(cut.drop("ids"))
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], np.uint32).tolist() for r in packing.sequences(cut).collect()}
    encode = reference()
    for r in placed.collect():
        ids = [*encode(pairs[r["doc_id"]][1]), packing.END_ID][r["start"] : r["start"] + r["length"]]
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids


def test_sequences_of_repeated_rows_and_rows_without_an_id(documents):
    pairs = [(1, "same text")] * 2 + [(None, "n")] * 3 + [(2, "other " * 700)]
    cut = packing.pieces(documents(pairs), *FILES)
    got = packing.sequences(cut).collect()
    encode = reference()
    texts = sorted([*encode(t), packing.END_ID] for _, t in pairs)
    found = [np.frombuffer(r["ids"], np.uint32).tolist() for r in got]
    assert [len(f) for f in found] == [r["length"] for r in got] and sum(map(len, found)) == sum(map(len, texts))
    assert sorted(x for f in found for x in f) == sorted(x for t in texts for x in t)
    assert packing.sequences(packing.pieces(documents([]), *FILES)).count() == 0
