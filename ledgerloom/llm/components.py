"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the edges, with partial
aggregation before each shuffle, so no task ever holds a node's neighbour list. A node
with over a ``HOT_SHARE``th of all edges is joined in parts; there are at most
``2 * HOT_SHARE`` such nodes, whatever the number of edges. Up to ``FEW`` edges are not
dealt by node at all: the nodes go to them.
Rounds end when the edges form stars around the smallest node of each component;
their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


HOT_SHARE, PARTS = 1000, 64
#: Edges up to which what is said of their nodes, at most twice as many rows of 24 bytes, is broadcast.
FEW = 200_000


def _join_nodes(edges: DataFrame, nodes: DataFrame, key: str, other: str, total: int) -> DataFrame:
    """``edges`` with what ``nodes`` (``key``, ``m``, ``n``: its edges) say of ``key``; hot nodes' edges are spread over parts by ``other``."""
    if total <= FEW:
        return edges.join(F.broadcast(nodes.drop("n")), key)
    is_hot = F.col("n") > max(total // HOT_SHARE, 10 * PARTS)
    hot = F.broadcast(nodes.where(is_hot).select(F.col(key).alias("_k"), F.lit(True).alias("_hot")))  # at most 2 * HOT_SHARE rows
    spread = edges.join(hot, edges[key] == hot["_k"], "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(other), F.lit(PARTS))).otherwise(F.lit(0)).cast("int"))
    each = nodes.select(key, "m", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))).alias("_part"))
    return spread.join(each, [key, "_part"]).select(*edges.columns, "m")


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has two long columns; nulls, loops, repeats and both directions are
    allowed. Returns ``node``, ``component``, one row per node; no edges: no rows.
    """
    x, y = edges.columns[:2]
    e = cut(
        edges.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        .where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y)))
        .distinct()
    )
    before = _digest(e)
    while before[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("a"), F.least("u", "m").alias("m"), "n")
        large = _join_nodes(e, least, "a", "b", before[0]).select(F.col("m").alias("a"), "b")
        low = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        pairs = _join_nodes(large, low, "b", "a", before[0]).select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        e = cut(pairs.select("e.a", "e.b").where("a < b").distinct())
        after = _digest(e)
        if after == before:
            break
        before = after
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select("a", "a").distinct())
