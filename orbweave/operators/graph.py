"""Connected components over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

#: Edges that a task joins at a time, and the most nodes that it remembers.
HELD = 1 << 19
#: So many links between roots are joined in one task, less than it may remember.
FEW = 1 << 17


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges and, for each, the least node that they lead to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        p, q = root[x], root[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def forest(edges: DataFrame) -> DataFrame:
    """(node, root): edges (a, b) that link the same, no more in a partition than it has nodes, the least node of each piece itself included.

    A task that meets more nodes than it may remember begins anew, so a node can come with several roots.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return roots(*[np.concatenate([h[i] for h in held]) for i in (0, 1)])

        for part in parts:
            if len(part):
                held.append((part["a"].to_numpy(), part["b"].to_numpy()))
                rows += len(part)
            if rows >= HELD:
                held = [joined()]
                rows = len(held[0][0])
                if rows >= HELD // 2:
                    yield pd.DataFrame(dict(zip(("node", "root"), held[0])))
                    held, rows = [], 0
        if held:
            yield pd.DataFrame(dict(zip(("node", "root"), joined())))

    return edges.select("a", "b").where("a is not null and b is not null").mapInPandas(run, f"node {kind}, root {kind}")


def _least(edges: DataFrame, before: int | None = None) -> DataFrame:
    """(node, component) for the nodes of edges: what each partition joins, then the roots that nodes have in common."""
    own = stage(forest(edges).groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("all")), "roots")
    links = own.where("size(all) > 1").select(F.col("root").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    links = stage(links, "links")
    count = links.count()
    if not count:
        return own.select("node", F.col("root").alias("component"))
    if count <= FEW:
        above = forest(links.coalesce(1)).select("node", F.col("root").alias("component"))
    elif before is None or count <= before // 2:
        above = _least(links.repartitionByRange("a"), count)
    else:
        above = _rounds(links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), links)
    above = above.select(F.col("node").alias("_n"), "component")
    return own.join(above.hint("merge"), F.col("root") == F.col("_n"), "left").select("node", F.coalesce("component", "root").alias("component"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node that links lead to, for every node.

    Tasks first join the edges that they have, in bounded memory; only a row a node is shuffled then, and again only what
    links the pieces of different tasks. Edges are read once.
    """
    found = _least(edges).select(F.col("node").alias("_node"), "component")
    return nodes.select("node").join(found.hint("merge"), F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component", "node").alias("component"))


def _rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same where pieces hardly join in tasks, long paths in no order for one: each round, every node takes the least
    label around it, then the label of that label; rounds are written out."""
    both = stage(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
    labels = stage(nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        hop = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = stage(hop.join(jump, F.col("component") == F.col("_n")).select("node", "old", F.least("component", "_c").alias("component")), "labels")
        moved = new.where("old <> component").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels
