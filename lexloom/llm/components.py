"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` (long, undirected) -> ``node``, ``component`` (smallest id reachable).

    Only nodes that have an edge appear; loops and repeated edges are allowed, an
    empty table gives an empty result. Each round hooks every node to its smallest
    neighbour, follows these pointers to their roots and contracts the edges to
    edges between roots. Rows per key are only ever reduced to a minimum, so a hub
    with very many neighbours costs one partial aggregate per task. Every round is
    written to the shared folder; the driver sees nothing but counts.
    """
    rest = materialise(_tidy(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), "edges")
    found = None
    while not rest.isEmpty():
        hooks = rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        hooks = _to_roots(materialise(hooks, "hooks"))
        r = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        if found is None:
            found = hooks
        else:
            moved = found.join(r, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            found = materialise(moved.unionByName(hooks), "labels")
        ra, rb = r.select(F.col("root").alias("a"), F.col("next").alias("na")), r.select(F.col("root").alias("b"), F.col("next").alias("nb"))
        lifted = rest.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"))
        rest = materialise(_tidy(lifted), "edges")
    if found is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = found.groupBy("node").agg(F.min("root").alias("component"))
    tops = labels.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return labels.unionByName(tops)


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _to_roots(hooks: DataFrame) -> DataFrame:
    """Follow pointers (each to a smaller id) until every node points at a root."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = materialise(hooks.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("_moved")), "hooks")
        hooks = jumped.select("node", "root")
        if jumped.where("_moved").isEmpty():
            return hooks
