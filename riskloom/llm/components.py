"""Connected components of a distributed edge list by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _map(edges: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``column`` replaced by its root where it has one.  Both sides are plain shuffles of stored tables, so a hub
    that many edges name is a skewed join key that adaptive execution splits."""
    r = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return (edges.join(r, column, "left")
            .select(*(F.coalesce("_root", column).alias(column) if c == column else F.col(c) for c in edges.columns)))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b) that is not itself the smallest of its component.

    Each round every node hooks to its smallest smaller neighbour, chains are shortened by pointer jumping, and
    edges inside a component vanish; a star, and most components, take one round."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        roots = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "hooks")
        while True:
            jumped = stored(roots.alias("x").join(roots.select(F.col("node").alias("root"), F.col("root").alias("_next")), "root", "left")
                            .select("node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "jumps")
            roots = jumped.select("node", "root")
            if jumped.filter("_moved").isEmpty():
                break
        if found is None:
            found = roots
        else:
            found = stored(_map(found, "root", roots).unionByName(roots), "roots")
        mapped = _map(_map(edges, "a", roots), "b", roots)
        edges = stored(mapped.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
