"""Connected components of a graph of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the component's smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of that label,
    so paths are halved; it ends when nothing changes. Minima are combined on the map side, so a
    node with very many links is no hot group. Every round's labels are written to the shared
    folder.
    """
    both = stored(
        edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct()
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = stored(
            lower.join(ahead, "label").select("node", "old", F.least("label", "next").alias("label"))
        )
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels
