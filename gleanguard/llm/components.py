"""Connected components by hooking and contraction; nothing but whether rows are left reaches the driver.

Each node hooks to its least neighbour (a sum with map-side combine), the trees that this makes are flattened by
doubling, and edges between their roots go on to the next round. A node with very many edges is never gathered: all
joins are of edges or labels with a table that has each node once, both dealt by plain exchanges, so that Spark splits
a hot node's rows over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanguard.llm.common import settled


def _hooked(edges: DataFrame) -> DataFrame:
    """(node, root): each node's least neighbour, or itself where that is less."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    return both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))


def _flat(labels: DataFrame) -> DataFrame:
    """Labels whose roots are their own, by doubling: log2 of the depth rounds."""
    while True:
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = settled(labels.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "labels")
        labels = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, root: the least node of its component) of all nodes of edges (a, b), roots included; a <> b in each edge."""
    out = None
    while True:
        labels = _flat(settled(_hooked(edges), "hooks"))
        if out is None:
            out = labels
        else:
            top = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
            out = settled(out.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        one, two = labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = settled(edges.join(one, "a").join(two, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return out
