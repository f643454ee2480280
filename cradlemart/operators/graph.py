"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

LOCAL_EDGES = 2_000_000  # edges that one task may join up in memory


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.setdefault(top, top)) != top:
            top = up
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; 64-bit names); root is the same all over a component.

    While there are more edges than one task may hold, every node gives way to its smallest
    neighbour, which takes away at least all but the local minima; the rest is joined up in one
    task. Names should be hashes, so that their order says nothing about the graph.
    """
    edges, steps = stored(edges.select("a", "b").distinct()), []
    while edges.count() > local_edges:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up")))
        steps.append(up)
        for end in ("a", "b"):
            edges = edges.join(up, edges[end] == up["node"]).select(F.col("up").alias(end), "b" if end == "a" else "a")
        edges = stored(edges.where("a <> b").distinct())
    roots = stored(edges.repartition(1).mapInArrow(_union_find, "node bigint, root bigint"))
    for up in reversed(steps):
        known = roots.select(F.col("node").alias("_node"), "root")
        roots = stored(up.join(known, up["up"] == known["_node"], "left").select("node", F.coalesce("root", "up").alias("root")))
    return roots
