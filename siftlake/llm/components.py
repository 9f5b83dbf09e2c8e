"""Connected components of a graph given by edges, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def components(edges: DataFrame, max_rounds: int = 60, between: Callable[[], None] = lambda: None) -> DataFrame:
    """(node, root) of every node that has an edge to another; root: the least node that is reachable.

    edges: (u: long, v: long), undirected, repeats and loops allowed. Each round hangs the greater
    neighbours of every node, then its lesser ones, under the least it knows; rounds grow with the
    logarithm of the size. Minima are combined before the shuffle and written, so the joins back to the
    edges are joins of two shuffles, in which a hub's partition can be split. between is called after each round.
    """
    e = settle(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "edges-least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.filter("u <> v").distinct(), "edges-large")
        # Now u > v in every edge: small stars gather the lesser neighbours of each node.
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")), "edges-low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, e = e, settle(small.filter("u <> v").distinct(), "edges")
        forget(before, least, large, low)
        now = _mark(e)
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        between()
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _mark(e: DataFrame):
    """Count and order-independent digest of the edges."""
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())
