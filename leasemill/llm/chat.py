"""Chat formatting of reply trees.

A tree's nodes name their parent. Root-to-leaf paths are enumerated by iterative self-joins that double their reach: round k
knows every node's ancestor 2**k steps up, and adds to each leaf's path the ancestors that lie as far beyond those it has. After
log2(depth) rounds each path is complete, as rows of ids; joins are on nodes, so no conversation is gathered before its
chosen paths are written out. Parents that form a circle are cut at its smallest node, which becomes a root. Branches are ranked by the sum of their nodes' scores (null: 0), then by leaf, and each chosen path becomes one text.

The template puts ``<|im_start|>role`` and a line break before a turn's text and ``<|im_end|>`` and a line break after it. Backslashes in
texts and roles are doubled, control strings get one after their first character, and a line break in a role becomes
``\\n``, so no text can open or close a turn and ``read_back`` returns what went in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leasemill.llm.store import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: How control strings of this and other chat templates begin.
_CONTROL = re.compile(r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])")
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """One text of (role, text) turns and, in code points, the places of the texts that count for the loss."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        head = OPEN + escape(role or "").replace("\n", "\\n") + "\n"
        body = escape(text or "")
        if role == LOSS_ROLE:
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), loss


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        turns.append((unescape(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(CLOSE) + 1
    return turns


def from_turns(rows: DataFrame) -> DataFrame:
    """Plain conversations ``(conv_id, turn, role, text, ...)`` as trees without branches: each turn answers the one before.

    Equal turns of a conversation are put in order by role and text, null turns come first.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", F.row_number().over(by_turn).cast("long").alias("node"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """``(conv, leaf, node, above, score, rank)``: the nodes of every chosen root-to-leaf path, ``above`` steps over its leaf.

    ``nodes`` has conv, node, parent, score; a parent that isn't there makes its node a root, and so does a circle of parents its smallest node.
    """
    own = nodes.select("conv", "node")
    links = nodes.where("parent is not null").select("conv", "node", F.col("parent").alias("up"))
    links = links.join(own.withColumnRenamed("node", "up"), ["conv", "up"], "left_semi").select("conv", "node", "up")
    jumps = _jumps(own, stored(links.withColumn("low", F.col("node")), "links"))
    if not jumps[-1].isEmpty():
        # What is left leads into circles: its upper ends are their nodes, and ``low``, the smallest node on the way, is that of the whole circle.
        on_circle = jumps[-1].select("conv", F.col("up").alias("node")).distinct()
        cut = jumps[-1].where(F.col("node") == F.col("low")).select("conv", "node").join(on_circle, ["conv", "node"], "left_semi")
        jumps = _jumps(own, stored(jumps[0].join(cut, ["conv", "node"], "left_anti"), "links"))
    leaves = own.join(jumps[0].select("conv", F.col("up").alias("node")).distinct(), ["conv", "node"], "left_anti")
    path = stored(leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above")), "paths")
    for k, links in enumerate(jumps[:-1]):
        higher = path.join(links, ["conv", "node"]).select("conv", "leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        path = stored(path.union(higher), "paths")
    scored = path.join(nodes.select("conv", "node", F.coalesce("score", F.lit(0.0)).alias("s")), ["conv", "node"])
    ranked = scored.groupBy("conv", "leaf").agg(F.sum("s").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    return path.join(ranked, ["conv", "leaf"])


def _jumps(own: DataFrame, links: DataFrame) -> list[DataFrame]:
    """``(conv, node, up, low)`` for 1, 2, 4 ... steps up, until none are left, or as many steps as the largest conversation has nodes.

    The last table is empty unless parents form a circle. Each has at most one row per node, so circles make no more rows than trees.
    """
    longest = own.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    jumps = [links]
    while not jumps[-1].isEmpty() and 1 << (len(jumps) - 1) < longest:
        on = jumps[-1].select("conv", F.col("node").alias("up"), F.col("up").alias("upper"), F.col("low").alias("lower"))
        further = jumps[-1].join(on, ["conv", "up"]).select("conv", "node", F.col("upper").alias("up"), F.least("low", "lower").alias("low"))
        jumps.append(stored(further, "links"))
    return jumps


def _format_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
        spans = pa.array([[{"start": a, "end": b} for a, b in loss] for _, loss in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        columns = {n: batch.column(n) for n in ("conv_id", "leaf", "rank", "score")}
        yield pa.RecordBatch.from_pydict(columns | {"formatted": pa.array([t for t, _ in done], pa.string()), "loss_spans": spans})


def format_trees(trees: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per chosen path of ``trees(conv_id, node, parent, role, text, score, ...)``: conv_id, leaf, rank, score, formatted, loss_spans.

    Rows with a null conv_id are one conversation; null roles and texts are empty; other columns are not looked at. A node's id is its own
    within a conversation; a node without an id cannot be answered and is the leaf of a path of its own, with a null leaf. No rows give no rows.
    """
    kind = {f.name: f.dataType.simpleString() for f in trees.schema}
    conv = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    nodes = stored(trees.select(conv.alias("conv"), "conv_id", "node", "parent", "role", "text", F.col("score").cast("double").alias("score")), "nodes")
    nameless = trees.schema["node"].nullable and not nodes.where("node is null").isEmpty()
    if nameless:
        # Ids become (id, number), where only nodes without an id have a number, so parents name none of those.
        none = F.lit(-1).cast("long")
        number = F.when(F.col("node").isNull(), F.monotonically_increasing_id()).otherwise(none)
        parent = F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("id"), none.alias("n")))
        nodes = stored(nodes.withColumns({"node": F.struct(F.col("node").alias("id"), number.alias("n")), "parent": parent}), "nodes")
    chosen = paths(nodes.select("conv", "node", "parent", "score"), branches)
    turns = chosen.join(nodes.select("conv", "conv_id", "node", "role", "text"), ["conv", "node"])
    turn = F.struct((-F.col("above")).alias("at"), "role", "text")
    rows = turns.groupBy("conv", "leaf").agg(F.first("conv_id").alias("conv_id"), F.first("rank").alias("rank"), F.first("score").alias("score"),
                                             F.array_sort(F.collect_list(turn)).alias("turns"))
    schema = f"conv_id {kind['conv_id']}, leaf {kind['node']}, rank int, score double, formatted string, loss_spans array<struct<start:long,end:long>>"
    return rows.select("conv_id", F.col("leaf.id" if nameless else "leaf").alias("leaf"), "rank", "score", "turns").mapInArrow(_format_rows, schema)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
            turns = read_back(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            out["formatted_chars"].append(len(text))
        yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id")} | out)


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted texts."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_digest_rows, schema)
