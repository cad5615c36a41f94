import hashlib
import math
import random

import numpy as np

from leasemill.llm import groups, vectorcodes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(3)


def brute(rows, parts=8, entries=16, rounds=6):
    """The contract in plain loops over every entry."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[[math.floor(4096 * x) for x in np.float32(v)[p * (len(v) // parts) : (p + 1) * (len(v) // parts)].tolist()] for p in range(parts)]
           for _, v, _ in kept]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(p, v[p])[1] for v in cut]
            for k in range(len(books[p])):
                mine = [v[p] for v, e in zip(cut, of) if e == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, total[label], sha) for (i, _, label), f, e in zip(kept, found, errors)), key=repr)


def got(df):
    return sorted((tuple(r) for r in V.digest(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)], rng.choice([0, 1, None])) for i in range(150)]
    # Ties and repeated rows, coarse values, and rows that are dropped.
    rows += [(200 + i, [rng.choice([0.0, 0.25, -0.25]) for _ in range(16)], 7) for i in range(60)]
    rows += [(3, rows[3][1], 1), (3, rows[3][1], 1), (None, rows[5][1], None)]
    rows += [(900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [math.nan] * 16, 1), (903, [math.inf] + [0.0] * 15, None)]
    assert got(frame(spark, rows)) == brute(rows)


def test_few_and_equal_vectors(spark):
    rows = [(i, [0.5] * 8, None) for i in range(20)]
    assert got(frame(spark, rows)) == brute(rows)
    rows = [(2, [0.1] * 8, 0), (1, [0.9, -0.9] * 4, 0)]
    assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(1, None, 0), (2, [], 0), (3, [1.0] * 9, 0)])) == []


def test_other_lengths_and_huge_components(spark):
    rows = [(1, [0.1] * 16, 0), (2, [0.1] * 8, 0), (3, [3e38] * 16, 0), (4, [-3e38] * 16, 0)]
    found = got(frame(spark, rows))
    assert [r[0] for r in found] == [1, 3, 4] and all(r[2] == 0 for r in found)


def test_orchard_takes_fewer_distances_than_all():
    rng = np.random.default_rng(5)
    centres = rng.integers(-3000, 3000, (16, 8, 4))
    vectors = centres[rng.integers(0, 16, 3000)] + rng.integers(-200, 200, (3000, 8, 4))
    books = V.Codebooks(centres.transpose(1, 0, 2))
    entry, distance, taken = books.nearest(vectors)
    every = ((vectors[:, :, None, :] - books.entries[None]) ** 2).sum(axis=3)
    assert (every.argmin(axis=2) == entry).all() and (every.min(axis=2) == distance).all()
    assert taken < 0.6 * every.size


def test_orchard_on_ties():
    entries = np.array([[[0, 0], [4, 0], [4, 0], [0, 4], [2, 2]]])
    vectors = np.array([[[2, 0]], [[4, 0]], [[2, 2]], [[2, 1]], [[9, 9]], [[0, 2]]])
    entry, distance, _ = V.Codebooks(entries).nearest(vectors)
    every = ((vectors[:, :, None, :] - entries[None]) ** 2).sum(axis=3)
    assert (every.argmin(axis=2) == entry).all() and (every.min(axis=2) == distance).all()


def test_groups_joined_with_a_hot_key(spark, monkeypatch, rows):
    monkeypatch.setattr(groups, "HOT", 4)
    data = [(i, k) for i, k in enumerate([None] * 30 + ["a"] * 50 + ["b", "c", "d", "e"] * 2)]
    df = spark.createDataFrame(data, "id long, key string")
    values = df.groupBy("key").count().withColumnRenamed("count", "n").selectExpr("key", "n", "n * 10 AS v")
    n = {k: sum(1 for _, x in data if x == k) for _, k in data}
    assert rows(groups.joined(df, values, "key"), "id", "key", "v") == sorted(((i, k, 10 * n[k]) for i, k in data), key=repr)
