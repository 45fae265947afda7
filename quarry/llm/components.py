"""Connected components of links, by contraction: every node hooks onto its smallest neighbour, trees are compressed by
doubling, and the links between their roots go on. Nothing is gathered in one task or on the driver; a node with very
many links costs no more than its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node, root (the smallest node that links reach) of links(a, b), for all nodes that have links. Both columns long,
    in either order. The table lives in scratch."""
    edges = scratch.keep(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges0")
    roots = None
    for k in range(64):
        if edges.isEmpty():
            break
        up = scratch.keep(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), f"{name}-up{k}")
        for j in range(64):
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            up2 = up.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            up2 = scratch.keep(up2, f"{name}-up{k}-{j}")
            if up2.where("moved").isEmpty():
                break
            up = up2.select("node", "root")
        a, b = (up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        edges = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = scratch.keep(edges, f"{name}-edges{k + 1}")
        if roots is None:
            roots = up
        else:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = roots.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            roots = moved.unionByName(up.join(roots.select("node"), "node", "left_anti"))
        roots = scratch.keep(roots, f"{name}-roots{k}")
    else:
        raise RuntimeError("links were not contracted in 64 rounds")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    tops = roots.select("root").distinct().select(F.col("root").alias("node"), "root")
    return scratch.keep(roots.unionByName(tops), f"{name}-all")
