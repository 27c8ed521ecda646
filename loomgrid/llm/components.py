"""Connected components of an edge table: union-find inside each partition, contraction across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges node - smallest node of its component, by union-find over the edges of one partition."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is its smallest reachable node.

    Each round points every node to its smallest neighbour, follows the pointers to their roots by
    doubling, and contracts the edges; the number of roots at least halves. Edges never meet on the
    driver, and a node with very many edges is pre-aggregated before each shuffle.
    An empty table gives an empty result; loops and repeated edges change nothing."""
    ship(edges.sparkSession)
    edges = cut(edges.select("a", "b").where("a != b").mapInArrow(_forest, "a long, b long"))
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        while True:
            far = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            step = cut(up.join(far, "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            up = step.select("a", "p")
            if step.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            labels = labels.join(up, labels["component"] == up["a"], "left").select("node", F.coalesce("p", "component").alias("component"))
        labels = cut(labels)
        edges = edges.join(up, "a").select("b", F.col("p").alias("pa"))
        edges = edges.join(up.withColumnRenamed("a", "b"), "b").select(F.col("pa").alias("a"), F.col("p").alias("b"))
        edges = cut(edges.where("a != b").mapInArrow(_forest, "a long, b long").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
