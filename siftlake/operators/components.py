"""Entity resolution: shared keys to connected components, without any pairs of a key's holders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.sources.scratch import scratch


def persisted(df: DataFrame) -> DataFrame:
    """df through a table in the shared folder: its lineage is cut, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolve(keys: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, cluster) of keys (node, key): nodes that share a key, directly or along a chain, have one cluster.

    The cluster is the least node of the component. Each round takes the least label of every key's
    holders and of every node's keys; minima are combined on the map side, so a key with very many
    holders is one row per task. Labels then jump to their label's label, which halves chains.
    """
    pairs = persisted(keys.filter("key IS NOT NULL AND node IS NOT NULL").select("node", "key").distinct())
    labels = persisted(pairs.select("node").distinct().withColumn("cluster", F.col("node")))
    for _ in range(rounds):
        least = pairs.join(labels, "node").groupBy("key").agg(F.min("cluster").alias("low"))
        near = pairs.join(least, "key").groupBy("node").agg(F.min("low").alias("low"))
        hop = labels.join(near, "node").select("node", "cluster", F.least("cluster", "low").alias("low"))
        jump = hop.select(F.col("node").alias("low"), F.col("low").alias("further"))
        moved = persisted(hop.join(jump, "low", "left").select("node", "cluster", F.least("low", F.coalesce("further", "low")).alias("now")))
        changed = moved.filter("now <> cluster").limit(1).count()
        labels = moved.select("node", F.col("now").alias("cluster"))
        if not changed:
            return labels
    raise RuntimeError(f"clusters did not settle within {rounds} rounds")


def quality(resolved: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: clusters, entities, purity (share of nodes in their cluster's plurality entity), fragments per entity."""
    both = resolved.join(truth, "node")
    cells = both.groupBy("cluster", "entity").agg(F.count(F.lit(1)).alias("n"))
    best = cells.groupBy("cluster").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    spread = cells.groupBy("entity").agg(F.count(F.lit(1)).alias("fragments"))
    one = F.lit(1).alias("one")
    left = best.groupBy(one).agg(F.count(F.lit(1)).alias("clusters"), (F.sum("best") / F.sum("n")).alias("purity"))
    right = spread.groupBy(one).agg(F.count(F.lit(1)).alias("entities"), F.avg("fragments").alias("fragmentation"))
    return left.join(right, "one").drop("one")
