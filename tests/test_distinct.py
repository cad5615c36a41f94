import random

from leasemill.operators import distinct

SCHEMA = "property_id string, tenant string, as_of_month string, suite_id string"


def rows():
    rng = random.Random(2)
    out = [(rng.choice(["p", "q", None]), f"t{rng.randrange(6)}", f"2001-{rng.choice([1, 2, 3, 5, 9, 12]):02d}", f"s{rng.randrange(300)}") for _ in range(900)]
    return out + [("p", None, "2002-01", "s1"), ("p", "t1", "2002-01", None), out[0], out[0]]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def expected(data, sizes=(3, 6, 9, 12)):
    at = lambda m: int(m[:4]) * 12 + int(m[5:])
    out = {}
    ends = {(p, m) for p, _, m, s in data if s is not None}
    for p, end in ends:
        for n in sizes:
            for q, t, m, s in data:
                if q == p and s is not None and 0 <= at(end) - at(m) < n:
                    out.setdefault((p, t, end, f"{n}m"), set()).add(s)
    return {k: len(v) for k, v in out.items()}


def counted(words):
    got = distinct.counts_by_window(words, ["property_id", "tenant"], ["property_id"], [3, 6, 9, 12])
    return {(r["property_id"], r["tenant"], r["end_month"], r["window_size"]): r["n_values"] for r in got.collect()}


BY = ["property_id", "tenant", "as_of_month"]


def test_windows_equal_sets(spark):
    df = frame(spark, rows())
    numbers = distinct.extend(None, df, "suite_id", ["property_id"])
    assert counted(distinct.words(df, numbers, "suite_id", BY, ["property_id"])) == expected(rows())


def test_months_added_one_by_one(spark):
    """Old words stay right while the dictionary grows, in whatever order months come."""
    data, numbers, words = rows(), None, None
    months = sorted({r[2] for r in data})
    random.Random(3).shuffle(months)
    for k in range(0, len(months), 3):
        df = frame(spark, [r for r in data if r[2] in months[k : k + 3]])
        before = numbers
        numbers = spark.createDataFrame(
            distinct.extend(numbers, df, "suite_id", ["property_id"]).collect(), "property_id string, suite_id string, number long")
        if before is not None:
            assert before.exceptAll(numbers).isEmpty()
        new = spark.createDataFrame(distinct.words(df, numbers, "suite_id", BY, ["property_id"]).collect(),
                                    "property_id string, tenant string, as_of_month string, word long, bits long")
        words = new if words is None else words.unionByName(new)
    assert numbers.count() == numbers.select("property_id", "number").distinct().count() == numbers.select("property_id", "suite_id").distinct().count()
    assert counted(words) == expected(data)


def test_gaps_in_the_dictionary_are_not_given_again(spark):
    df = frame(spark, [("p", "t", "2001-01", f"s{i}") for i in range(9000)])
    numbers = distinct.extend(None, df, "suite_id")
    left = spark.createDataFrame(numbers.where("number % 3 = 0").collect(), "suite_id string, number long")
    again = distinct.extend(left, df, "suite_id")
    assert again.count() == again.select("number").distinct().count() == 9000


def test_all_64_bits(spark, monkeypatch):
    monkeypatch.setattr(distinct, "PARTS", 1)
    df = frame(spark, [("p", "t", "2001-01", f"s{i}") for i in range(130)])
    words = distinct.words(df, distinct.extend(None, df, "suite_id"), "suite_id", ["tenant"])
    assert sorted((r["word"], r["bits"]) for r in words.collect()) == [(0, -1), (1, -1), (2, 3)]
    assert [tuple(r) for r in distinct.counts(words, ["tenant"]).collect()] == [("t", 130)]


def test_no_rows(spark):
    df = frame(spark, [])
    words = distinct.words(df, distinct.extend(None, df, "suite_id"), "suite_id", BY)
    assert distinct.counts_by_window(words, ["tenant"]).count() == 0


def test_windows_do_not_read_the_rows(spark, tmp_path):
    df = frame(spark, rows())
    distinct.words(df, distinct.extend(None, df, "suite_id"), "suite_id", BY).write.parquet(str(tmp_path / "w"))
    got = distinct.counts_by_window(spark.read.parquet(str(tmp_path / "w")), ["tenant"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "suite_id" not in plan


def test_sets_are_shuffled_before_they_unfold(spark):
    """A word row reaches twelve end months; those rows are counted where they are made."""
    words = spark.createDataFrame([("p", "t", "2001-01", 0, 1)], "property_id string, tenant string, as_of_month string, word long, bits long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for by, keys in ((["tenant"], []), (["property_id", "tenant"], ["property_id"])):
            plan = distinct.counts_by_window(words, by, keys)._jdf.queryExecution().toString()
            dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "word#" in line]
            assert dealt and not any("_end#" in line or "end_month#" in line for line in dealt)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
