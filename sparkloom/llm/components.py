"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to (node, root): a spanning forest of the edges that one task read."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


def connected(edges: DataFrame, label: str = "component") -> DataFrame:
    """node, component (the smallest node it is linked with) of every node that an edge (a long, b long) touches.

    Each task first reduces its own edges to a forest. Then two kinds of stars alternate: every node sends its larger
    neighbours to its smallest one, then its smaller neighbours. Every round works on sets of edges no larger than the
    first; it ends when nothing moves, after a number of rounds logarithmic in practice. Each round is written down, and so
    are the smallest neighbours: a node may have a third of all edges, and adaptive execution splits it where both sides
    of a join are scans.
    """
    directed = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(directed.mapInArrow(_forest, "a long, b long"), "forest")
    state = None
    while True:
        facts = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if facts["n"] == 0 or (facts["n"], facts["s"]) == state:
            break
        state = (facts["n"], facts["s"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
    return now.select(F.col("a").alias("node"), F.col("b").alias(label)).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias(label)).distinct())
