"""Connected components of a graph given as a table of edges.

Edges are rewired in rounds until every node points at the smallest node of its
component: a large-star round links the larger neighbours of a node to the
smallest node it knows, a small-star round links the smaller ones.  Rounds halve the
distance to the smallest node, so their number grows with the logarithm of the component's
diameter.  A round's edges are a written table, so a lost executor costs a
reread; a hub's rows sit on the splittable side of a join of two exchanges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import settle


def _smallest_neighbours(edges: DataFrame, label: str) -> DataFrame:
    """(u, low): the least of each node and its neighbours."""
    return settle(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")), label)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest_neighbours(both, "large-star-low")
    return (
        both.join(low, "u")
        .filter("v > u")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _smallest_neighbours(down, "small-star-low")
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = low.select("u", F.col("low").alias("v"))
    return moved.unionByName(own).filter("u > v").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not itself the smallest of its component.

    ``edges`` has columns ``u`` and ``v`` of one ordered type, in any direction, repeats and
    loops allowed; no edges give no rows.
    """
    edges = settle(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u > v")
        .distinct(),
        "edges",
    )
    before = _fingerprint(edges)
    while before[0]:
        edges = settle(_small_star(settle(_large_star(edges), "large-star")), "small-star")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
