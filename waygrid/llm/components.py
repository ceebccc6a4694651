"""Connected components by alternating large-star and small-star steps on an edge table.

Each step replaces a node's edges by edges to its smallest neighbour, so hubs are never expanded into pairs: the
number of edges does not grow. Minima are pre-aggregated before they are shuffled. Where the edges are few by count, the
minima are sent to all tasks and the edge table is kept in few partitions, so that a round has three exchanges of few
files; else the join back to the edges has an exchange of its own on both sides, so that Spark can split a hub's rows
over tasks. Both ways give the same rows. Every round ends in a checkpoint in the shared folder; the driver sees two
numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.llm.shared import SENT_ROWS, cut

MOST_ROUNDS = 60
#: Edges that a partition of a coalesced edge table holds at least.
PARTITION_EDGES = 100_000


def _to_least(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """Edges (u, v) with the least neighbour m of u. The hash is part of the key so that the minima, which lie dealt
    out by x, are dealt out anew: then both sides have an exchange of the join's own, and a hub's rows can be split."""
    if few:
        return edges.join(F.broadcast(least), F.col("u") == F.col("x"))
    return edges.join(least, (F.col("u") == F.col("x")) & (F.xxhash64("u") == F.xxhash64("x")))


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every larger neighbour of u goes to the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
    return _to_least(both.filter("v > u"), least, few).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """u and its smaller neighbours go to the smallest of them. Edges run from the larger node u to the smaller v."""
    least = edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
    moved = _to_least(edges, least, few).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(least.select(F.col("x").alias("u"), F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (u, v); root is the smallest node of its component. Links to oneself and
    null ends are left out; repeated and reversed links count once."""
    edges = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        few = 2 * state[0] <= SENT_ROWS
        partitions = -(-state[0] // PARTITION_EDGES) or 1
        start = edges.coalesce(partitions) if few else edges
        moved = _small_star(_large_star(start, few), few).distinct()
        edges = cut(moved.coalesce(partitions) if few else moved)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def named(nodes: DataFrame, name: str) -> DataFrame:
    """(node, root, the least ``name`` of the root's nodes) for nodes (node, root, name). The names are pre-aggregated;
    the join back has an exchange of its own on both sides, so that Spark can split a large component's rows."""
    least = nodes.groupBy(F.col("root").alias("of_root")).agg(F.min(name).alias("least_name"))
    same = (F.col("root") == F.col("of_root")) & (F.xxhash64("root") == F.xxhash64("of_root"))
    return nodes.join(least, same).select("node", "root", F.col("least_name").alias(name))
