"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.sources.storage import materialized

MAX_ROUNDS = 60


def _starred(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of every node to its smallest neighbour; self links are left out."""
    if larger_only:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = sides.join(least, "a")
    if larger_only:
        return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    linked = out.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root that hangs on nothing; counts per node are combined before the shuffle."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))))
    counts = edges.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return counts.where("up > 1 or up = 1 and least = 0").isEmpty()


def components(edges: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest node that can be reached.

    Minima are aggregated before they are shuffled and the joins are open to skew splitting, so a node of very
    many edges is no hot task. Every round is written to the shared folder; it ends when all edges are stars
    around the smallest node, after a number of rounds logarithmic in the size of the components.
    """
    edges = edges.where("a <> b").select("a", "b").distinct()
    for _ in range(MAX_ROUNDS):
        edges = materialized(_starred(_starred(edges, True), False), scratch)
        if _is_settled(edges):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def extended(roots: DataFrame, links: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """Components (node, root) after further links (a, b): only the roots that the links join are searched again."""
    if links.isEmpty():
        return roots
    for side in ("a", "b"):
        own = roots.select(F.col("node").alias(side), F.col("root").alias("top"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce("top", side)).drop("top")
    joined = materialized(components(links, scratch), scratch)
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return old.unionByName(joined.join(roots, "node", "left_anti"))
