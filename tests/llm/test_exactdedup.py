import hashlib

from leasemill.llm import exactdedup as X


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_index_grows_finds_and_forgets():
    index = X.CuckooIndex(4)
    small = index.buckets
    places = {i: index.insert(key(i)) for i in range(3000)}
    assert index.buckets > small and all(index.find(key(i)) == p for i, p in places.items())
    assert all(index.find(key(i)) == -1 for i in range(3000, 6000))
    assert all(index.delete(key(i)) == places[i] for i in range(0, 3000, 2))
    assert all((index.find(key(i)) == -1) == (i % 2 == 0) for i in range(3000)) and index.delete(key(0)) == -1
    assert index.insert(key(0)) == index.find(key(0)) == 3000


def test_equal_fingerprints_are_verified():
    index = X.CuckooIndex()
    same = [bytes(8) + key(i) for i in range(9)]  # one fingerprint, one bucket: at most eight fit in two buckets
    for k in same[:8]:
        assert index.find(k) == -1
        index.insert(k)
    assert [index.find(k) for k in same] == [*range(8), -1]


def test_groups(documents):
    pairs = [(5, "a b"), (3, "ab"), (4, " ab\n"), (1, None), (2, ""), (9, "é "), (8, "é"), (7, "a b"), (7, "a b"), (None, "z"), (6, "z" * 200_000)]
    got = sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in X.exact_duplicates(documents(pairs, "digest")).collect())
    assert got == [(-1, None, 1, True), (1, 1, 2, True), (2, 1, 2, False), (3, 4, 5, False), (4, 4, 5, True), (5, 4, 5, False), (6, 6, 1, True),
                   (7, 4, 5, False), (7, 4, 5, False), (8, 8, 1, True), (9, 9, 1, True)]
    assert X.exact_duplicates(documents([])).count() == 0


def test_longest_then_smallest(documents):
    rows = {r["doc_id"]: r for r in X.exact_duplicates(documents([(3, "x  y"), (2, "x y "), (1, "xy")])).collect()}
    assert {r["keep_id"] for r in rows.values()} == {2} and rows[2]["kept"]
    assert rows[1]["text_sha256"] == hashlib.sha256(b"xy").hexdigest()


def test_index_table_takes_and_loses_batches(spark, documents):
    index = X.build(X.digests(documents([(i, f"text {i % 40}") for i in range(100)])))
    assert index.count() == 40
    index = X.add(index, X.digests(documents([(1000, "text 0"), (1001, "new")])))
    assert index.count() == 41 and index.agg({"size": "sum"}).first()[0] == 102
    dead = X.digests(documents([(0, "text 1"), (0, "never there")])).select("digest")
    assert X.remove(index, dead).count() == 40
