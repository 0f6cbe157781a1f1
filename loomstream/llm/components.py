"""Connected components of links between 64-bit nodes, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of links (a, b) the smallest node that links reach; self-links are allowed.

    Each round points nodes at smaller neighbours with aggregations and joins only, and is checkpointed; the number of
    rounds is logarithmic in practice.  Null ends are ignored; no links give no rows.
    """
    edges = checkpoint(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = links.where("a IS NOT NULL AND b IS NOT NULL").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    last = None
    while True:
        # Large star: each node links its larger neighbours to the least of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node links its smaller neighbours and itself to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = checkpoint(small.where("u <> v").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            break
        last = state
    return nodes.join(edges, nodes["node"] == edges["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
