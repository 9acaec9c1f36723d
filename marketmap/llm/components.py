"""Connected components of a link table, as iterated joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmap.llm.common import stored


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then the label of that label
    (pointer jumping), so the number of rounds grows with the logarithm of the longest chain. Labels
    are written each round, so a round never recomputes an earlier one."""
    pairs = links.select("a", "b").distinct()
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), name)
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                    .select(F.col("a").alias("node"), "label", F.lit(True).alias("changed")), name)
    while not labels.filter("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.drop("changed").join(near, "node") \
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        labels = stored(step.join(jump, "label").select(
            "node", F.least("label", "jump").alias("label"), (F.least("label", "jump") < F.col("old")).alias("changed")), name)
    return labels.select("node", F.col("label").alias("component"))
