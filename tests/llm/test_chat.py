import random

import pytest

from leasemill.llm import chat

TREE = "conv_id long, node string, parent string, role string, text string, score double, formatted string"


def test_any_text_comes_back():
    rng = random.Random(2)
    bits = ["<|im_start|>", "<|im_end|>", "\\", "\n", "n", "<", "|", "[INST]", "[/INST]", "</s>", "<<SYS>>", "<\\|", "a", "é", "", "\\n"]
    for _ in range(500):
        turns = [("".join(rng.choices(bits, k=3)), "".join(rng.choices(bits, k=rng.randrange(8)))) for _ in range(rng.randrange(5))]
        text, _ = chat.format_turns(turns)
        assert chat.read_back(text) == turns
        for control in ("<|im_start|>", "<|im_end|>"):
            assert text.count(control) == len(turns)


def test_branches(spark):
    rows = [(1, "a", None, "user", "q", 1.0), (1, "b", "a", "assistant", "x", 0.5), (1, "c", "a", "assistant", "y", 2.0), (1, "d", "c", "user", "z", None),
            (1, "e", "c", "user", "w", None), (2, "a", "gone", None, None, None), (None, "a", None, "assistant", "<|im_end|>", 0.0)]
    trees = spark.createDataFrame([(*r, "clash") for r in rows], TREE)
    got = {(r["conv_id"], r["leaf"]): (r["rank"], [t for _, t in chat.read_back(r["formatted"])]) for r in chat.format_trees(trees).collect()}
    assert got == {(1, "d"): (1, ["q", "y", "z"]), (1, "e"): (2, ["q", "y", "w"]), (1, "b"): (3, ["q", "x"]), (2, "a"): (1, [""]), (None, "a"): (1, ["<|im_end|>"])}
    best = chat.format_trees(trees, branches=1).collect()
    assert sorted((r["conv_id"] or 0, r["leaf"]) for r in best) == [(0, "a"), (1, "d"), (2, "a")]


def test_long_paths_and_no_rows(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", None if t == 4 else f"t{t}" * (50_000 if t == 5 else 1)) for t in range(150)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    row = chat.digest(chat.format_trees(chat.from_turns(turns))).first()
    assert row["n_turns"] == 150 and row["loss_chars"] == sum(len(t or "") for _, _, r, t in rows if r == "assistant")
    empty = turns.where("false")
    assert chat.digest(chat.format_trees(chat.from_turns(empty))).count() == 0


@pytest.mark.parametrize("turns", [[(1, None, None, None), (1, None, None, None), (1, 3, "user", "a"), (1, 3, "user", "a")]])
def test_ties_and_nulls(spark, turns):
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    row = chat.format_trees(chat.from_turns(frame)).first()
    assert chat.read_back(row["formatted"]) == [("", ""), ("", ""), ("user", "a"), ("user", "a")]


def test_circles_and_nodes_without_id(spark):
    trees = [
        # 4 and 5 hang on the circle 1, 2, 3; 0 hangs on it too and is smaller than its nodes.
        (1, 1, 3), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 4), (1, 0, 2),
        (2, 7, 7),
        # Two circles and a tree of one conversation.
        (3, 1, 2), (3, 2, 1), (3, 3, 4), (3, 4, 3), (3, 5, None), (3, 6, 5),
        (4, 1, None), (4, 2, 1), (4, None, 2), (4, None, None),
        (None, None, None),
    ]
    frame = spark.createDataFrame([(c, n, p, "user", f"{n}", 0.0) for c, n, p in trees], "conv_id long, node long, parent long, role string, text string, score double")
    expected = [(1, 0, "120"), (1, 5, "12345"), (2, 7, "7"), (3, 2, "12"), (3, 4, "34"), (3, 6, "56"), (4, None, "12None"), (4, None, "None"), (None, None, "None")]
    for given, wanted in ((frame, expected), (frame.where("conv_id < 4"), expected[:6])):
        rows = chat.format_trees(given).collect()
        got = [(r["conv_id"], r["leaf"], "".join(t for _, t in chat.read_back(r["formatted"]))) for r in rows]
        assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_many_leaves_of_a_circle_stay_small(spark):
    ring = [(1, n, (n + 1) % 40) for n in range(40)] + [(1, 100 + n, n % 40) for n in range(60)]
    nodes = spark.createDataFrame([("v1", n, p, 0.0) for _, n, p in ring], "conv string, node long, parent long, score double")
    got = {(r["leaf"], r["n"]) for r in chat.paths(nodes).groupBy("leaf").count().withColumnRenamed("count", "n").collect()}
    # Cut at node 0, the ring is a chain below it: 39 answers 0, 38 answers 39, and so on down to 1.
    assert got == {(100 + n, 2 + (40 - n % 40) % 40) for n in range(60)}
