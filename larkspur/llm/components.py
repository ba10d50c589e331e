"""Connected components over an edge table, by alternating star contraction.

An iteration links all larger neighbours of each node to its least neighbour (large star), then all neighbours
that are not larger, and the node itself, likewise (small star). When nothing changes, each node has one edge, to the
least node of its component. Each half step is a grouped minimum (partial sums before the shuffle, so hubs
are no hot keys) and an equi-join (skewed sides are split at run time). Edge tables go through the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources.shared import materialize, remove


#: Edges to a file of an edge table.
PER_FILE = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v); the star of each u over its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).where("u > v")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge the least node of its component.

    Edges are undirected pairs of nodes, of one type that has an order, in columns ``a`` and ``b``; rows with a null and self
    loops are ignored, repeated edges count once, no edges give no rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNull() | F.col(b).isNull()).alias("gap"))
    now = materialize(now.where("not gap and u > v").select("u", "v").distinct(), "edges")
    rows, before = now.count(), None
    while True:
        # few edges go to few files
        files = -(-rows // PER_FILE) or 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_star(both, True).distinct().coalesce(files), "large")
        # a node's neighbours that are not larger: the edges as they are, since u > v
        new = materialize(_star(large, False).distinct().coalesce(files), "small")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(now.sparkSession, now)
        remove(now.sparkSession, large)
        now = new
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
        rows, before = mark[0], mark


def heads(edges: DataFrame, ranks: DataFrame, key: str, rank: str) -> DataFrame:
    """(key, head): for every key of an edge (a, b) the least rank of its component.

    ranks: (key, rank), one row a key. Nodes are ordered by rank and carry it, so a component is named by its least rank as it is
    found: nothing is joined or grouped by component, which may hold a third of all keys. A null rank comes last.
    """
    node = F.struct(F.col(rank).isNull().alias("last"), F.col(rank).alias("rank"), F.col(key).alias("key"))
    of = ranks.select(F.col(key).alias("k"), node.alias("node"))
    a, b = (of.select(F.col("k").alias(x), F.col("node").alias(f"node_{x}")) for x in ("a", "b"))
    found = components(edges.join(a, "a").join(b, "b"), "node_a", "node_b")
    return found.select(F.col("node.key").alias(key), F.col("component.rank").alias("head"))
