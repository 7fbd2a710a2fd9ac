"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conform.session import stage


def _star(pairs: DataFrame, folder: str | None) -> DataFrame:
    """(node, least) for every ``node``: the least of itself and its neighbours ``other``."""
    return stage(pairs.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("least")), "least", folder)


def _large(edges: DataFrame, folder: str | None) -> DataFrame:
    """Hang every larger neighbour of a node under the node's least neighbour."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                                          F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
    joined = both.join(_star(both, folder), "node").filter(F.col("other") > F.col("node"))
    return joined.select(F.col("other").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame, folder: str | None) -> DataFrame:
    """Hang a node and its smaller neighbours under the least of them."""
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = _star(down, folder)
    moved = down.join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    own = least.select(F.col("node").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", folder: str | None = None) -> DataFrame:
    """(``node``, ``root``) of every node that has an edge to another; the root is the least node of its component.

    Large-star and small-star steps alternate until the edges stay as they are; about log(n) rounds. No node's edges are
    gathered in one place: a step is an aggregation with partial sums and an equi join of stored tables, which adaptive
    execution splits where one node holds many edges. Edges with a null end and loops are left out; no edges, no rows. Node
    values may have any orderable type. Working tables go to ``folder``, by default to the shared one.
    """
    e = stage(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct(), "edges", folder)
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        e = stage(_small(stage(_large(e, folder), "edges", folder), folder), "edges", folder)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
