import random

import brute
import numpy as np

from leasemill.llm import neardup, texts
from leasemill.llm.graph import components


def near_texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([3, 5, 8, 30, 90, 300]))
        for _ in range(rng.choice([1, 3, 9])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def check(frame, pairs, width):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}
    assert got == brute.near_components(pairs, width, 80)


def test_equals_brute_force(documents):
    many = near_texts() + ["", " \n", "one", "ONE", "two words", "two\twords", "É a", "é a"]
    pairs = [(7 * i % 1009, t) for i, t in enumerate(many)] + [(5000, None), (5001, " ".join(f"v{i % 911}" for i in range(30_000)))]
    for width in (2, 5):
        check(neardup.near_duplicates(documents(pairs, "node"), width, 80), pairs, width)


def test_large_group_of_near_copies(documents):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    pairs = []
    for i in range(400):
        copy = list(base)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(60)] = f"c{rng.randrange(50)}"
        pairs.append((i, " ".join(copy)))
    check(neardup.near_duplicates(documents(pairs), 2, 80), pairs, 2)


def test_no_rows_and_repeated_rows(documents):
    assert neardup.near_duplicates(documents([])).count() == 0
    rows = neardup.near_duplicates(documents([(1, "a b c d e f"), (1, "a b c d e f"), (None, "q r s t u v")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (1, 1, True), (1, 1, True)]


def test_estimate_follows_similarity():
    rng = np.random.Generator(np.random.PCG64(5))
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for shared in (500, 800, 950):
        a, b = np.unique(values[:1000]), np.unique(values[1000 - shared : 2000 - shared])
        s = neardup.signatures([a, b])
        exact = shared / (2000 - shared)
        assert abs(float(neardup.estimate(s[:1], s[1:])[0]) - exact) < 0.1
    assert texts.mix(values[:1]).dtype == np.uint64


def test_unlinked_texts_of_one_template_meet_once(spark, documents, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_NODES", 64)
    rng = random.Random(9)
    shared, n = [f"t{i}" for i in range(70)], 300
    pairs = [(i, " ".join(shared + [f"own{i}x{k}" for k in range(15)])) for i in range(n)]
    rng.shuffle(pairs)
    docs = documents(pairs)
    nodes = neardup.shingle_nodes(docs, 2)
    distinct = neardup.stored(nodes.where("node is not null").groupBy("node").agg(neardup.F.first("signature").alias("signature")), "distinct")
    groups = neardup._with_hub(distinct.mapInArrow(neardup._band_rows, "band long, node binary"))
    none = spark.createDataFrame([], "a binary, b binary")
    seen, looked = set(), 0
    for _, cell in neardup.cells(groups, components(none), distinct).toPandas().groupby("share"):
        registers = np.frombuffer(b"".join(cell["signature"]), np.uint16).reshape(-1, neardup.REGISTERS)
        assert len(cell) <= 8 * 64
        node = cell["node"].tolist()
        for a, b in zip(*neardup.first_pairs(cell, registers)):
            seen.add(frozenset((bytes(node[a]), bytes(node[b]))))
            looked += 1
    # Every pair at most once; together with the pairs of hubs all that share a band of two or more others.
    assert looked == len(seen) <= n * (n - 1) // 2
    keys = {bytes(r["node"]): neardup.band_keys(np.frombuffer(bytes(r["signature"]), np.uint16)[None])[0] for r in distinct.collect()}
    hubs, sizes = {}, {}
    for r in groups.collect():
        hubs[r["band"]], sizes[r["band"]] = bytes(r["hub"]), r["size"]
    names = sorted(keys)
    for i, a in enumerate(names):
        for b in names[:i]:
            both = [int(k) for k in keys[a][keys[a] == keys[b]]]
            first = min(both, default=None)
            settled = first is None or hubs[first] in (a, b)
            decided = any(hubs[k] in (a, b) for k in both)
            assert (frozenset((a, b)) in seen) == (not settled) or decided
    check(neardup.near_duplicates(docs, 2, 80), pairs, 2)


def test_links_outside_the_hubs_component(documents, monkeypatch):
    """Families that share bands with another family's hub are joined by links of their own."""
    monkeypatch.setattr(neardup, "BLOCK_NODES", 4)
    rng = random.Random(11)
    shared = [f"t{i}" for i in range(150)]
    pairs = []
    for family in range(8):
        base = shared + [f"f{family}x{k}" for k in range(40)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(12)):
                copy[rng.randrange(len(copy))] = f"c{rng.randrange(90)}"
            pairs.append((len(pairs), " ".join(copy)))
    check(neardup.near_duplicates(documents(pairs), 2, 80), pairs, 2)
