"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasemill.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """The component of every linked node: ``(node, root)``, one row per node that occurs in ``links(a, b)``.

    Each round maps every node to the smallest of itself and its neighbours and contracts the links to those; nodes that
    have reached their root take no further part. Links shrink from round to round, nothing is collected, and every
    round is a written table, so a lost executor repeats one round at most. Self links make nodes of their own; null ends are no links.
    """
    links = links.where("a is not null and b is not null").select("a", "b")
    label, edges = None, stored(links.where("a <> b").distinct(), "links")
    alone = links.select(F.col("a").alias("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lower = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to"))
        lower = stored(lower, "lower")
        if label is None:
            label = lower.select("node", F.col("to").alias("root"))
        else:
            label = label.join(lower.select(F.col("node").alias("root"), "to"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root"))
        label = stored(label, "labels")
        to = lower.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        half = edges.join(to, "a").select("b", "ra")
        to = lower.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        edges = half.join(to, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = stored(edges.distinct(), "links")
    alone = alone.select("node", F.col("node").alias("root")).distinct()
    return alone if label is None else label.union(alone.join(label, "node", "left_anti"))
