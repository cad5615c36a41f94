import random

import brute

from leasemill.llm import decontaminate as D


def frames(spark, documents, pairs, items):
    return documents(pairs, "items"), spark.createDataFrame(items, "item_id long, text string")


def case():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([2, 9, 10, 14, 25])))) for i in range(12)]
    items += [(90, ""), (91, None), (92, "?!"), (3, "also three is item number three with more than ten words here")]
    pairs = []
    for i in range(60):
        text = rng.choices(words, k=rng.randrange(80))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = (rng.choice(items)[1] or "").split()[: rng.choice([9, 10, 11, 30])]
        pairs.append((i, rng.choice([" ", ", ", "-", "\n"]).join(text).title()))
    pairs += [(100, None), (101, ""), (102, "É" * 50_000), (103, f"x{items[0][1]}"), (104, " ".join(f"{w}." for w in items[1][1].split()))]
    return pairs, items


def check(spark, documents):
    pairs, items = case()
    docs, bench = frames(spark, documents, pairs, items)
    got = {r["doc_id"]: r["f"] for r in docs.select("doc_id", D.contamination(docs, bench).alias("f")).collect()}
    expected = brute.contamination(pairs, items)
    for i, text in pairs:
        hit = sum(s["end"] - s["start"] for s in got[i]["word_spans"])
        assert (got[i]["n_words"], hit, got[i]["items"]) == expected[i]
        marked = [w for s in got[i]["spans"] for w in brute.words(text[s["start"] : s["end"]])]
        assert marked == [w for s in got[i]["word_spans"] for w in brute.words(text)[s["start"] : s["end"]]]


def test_equals_brute_force(spark, documents):
    check(spark, documents)


def test_items_in_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 20)
    check(spark, documents)


def test_nothing_to_find(spark, documents):
    docs, bench = frames(spark, documents, [(1, "a b c"), (1, "a b c")], [])
    assert [r["contaminated"] for r in D.digest(docs, bench).collect()] == [False, False]
    docs, bench = frames(spark, documents, [], [(1, "a b c")])
    assert D.digest(docs, bench).count() == 0
