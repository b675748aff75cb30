"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gneiss.staging import drop, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Edges have a > b."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    pairs = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return pairs.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is its smallest node.

    Self-loops and repeated edges are allowed; nulls are ignored; a node that
    appears only in a self-loop is its own component. Every round is one
    large-star and one small-star step whose result is staged, so lineage and
    recovery stay bounded. The groups are reduced by partial minima before they
    are shuffled, and the joins can be split where one node has most edges.
    """
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    current = stage(raw.distinct(), "edges")
    loops = current.filter("a = b").select(F.col("a").alias("node")).distinct()
    first, state = current, None
    current = current.filter("a <> b")
    for _ in range(max_rounds):
        after = stage(_small_star(_large_star(current)), "stars")
        summary = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state is not None:
            drop(current)
        current, before, state = after, state, tuple(summary)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = members.unionByName(roots)
    alone = loops.join(out.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    out = stage(out.unionByName(alone), "components")
    drop(first)
    drop(current)
    return out
