"""Approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import best, matrix, usable


@dataclass(frozen=True)
class Settings:
    """sample: rows that the tree is fitted on, at most. branches: children of a node. leaf: sampled rows that a leaf
    holds. tested: sampled queries that the number of leaf visits is calibrated with. recall: what it must reach.
    chunk: rows, and queries, of a leaf that meet in one task."""

    k: int = 10
    sample: int = 20_000
    branches: int = 8
    leaf: int = 100
    tested: int = 200
    recall: float = 0.985
    chunk: int = 4_096
    seed: int = 7


@dataclass
class Tree:
    """Nodes by number: centre, children; leaves have none. Node 0 is the root."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)

    def leaves(self) -> int:
        return sum(not c for c in self.children)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row, by the nearest child from the root down."""
        out = np.zeros(len(x), dtype=np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            below = self.children[node]
            if not below or not len(rows):
                out[rows] = node
                continue
            nearest = _distances(x[rows], np.stack([self.centres[c] for c in below])).argmin(axis=1)
            stack += [(c, rows[nearest == i]) for i, c in enumerate(below)]
        return out

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, the one of the nearest waiting node first."""
        waiting = [(0.0, 0)]
        while waiting:
            _, node = heapq.heappop(waiting)
            below = self.children[node]
            if not below:
                yield node
                continue
            for d, c in zip(((np.stack([self.centres[c] for c in below]) - query) ** 2).sum(axis=1).tolist(), below):
                heapq.heappush(waiting, (d, c))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None, :]


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _distances(x, centres).argmin(axis=1)
        centres = np.stack([x[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(k)])
    return centres


def fit(x: np.ndarray, s: Settings) -> Tree:
    """A tree over rows x; nodes are split while they hold more than s.leaf rows and differ."""
    rng, tree = np.random.default_rng(s.seed), Tree([x.mean(axis=0)], [[]])
    stack = [(0, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        if len(rows) <= s.leaf or (x[rows] == x[rows[0]]).all():
            continue
        centres = _k_means(x[rows], min(s.branches, len(rows)), rng)
        nearest = _distances(x[rows], centres).argmin(axis=1)
        parts = [rows[nearest == i] for i in range(len(centres))]
        if max(map(len, parts)) == len(rows):
            continue
        for centre, part in zip(centres, parts):
            if len(part):
                tree.centres.append(centre)
                tree.children.append([])
                tree.children[node].append(len(tree.centres) - 1)
                stack.append((len(tree.centres) - 1, part))
    return tree


def calibrate(tree: Tree, x: np.ndarray, s: Settings) -> int:
    """Leaf visits after which s.recall of the true neighbours of sampled queries, among the sample, have been met.

    Neighbours in the sample lie further away than those in all rows, so the number errs to more visits.
    """
    rng = np.random.default_rng(s.seed)
    tested = rng.choice(len(x), min(s.tested, len(x)), replace=False)
    leaf, needed = tree.assign(x), []
    for q in tested:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[: min(s.k, len(x) - 1)]
        order = {node: i for i, node in enumerate(tree.visit(x[q]))}
        needed += [order[n] + 1 for n in leaf[near].tolist()]
    return int(np.quantile(needed, s.recall, method="higher")) if needed else 1


def nearest(table: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found, by Euclidean distance in double precision.

    The tree is fitted on the rows with the smallest hashes of their ids, at most settings.sample; every row is then dealt
    to a leaf. A query visits leaves best bin first, widening until the calibrated number is reached. Rows and queries
    meet by leaf; a leaf with many rows or many queries is cut into chunks that meet pair by pair, so no task grows with
    it. Distances are taken from the vectors themselves.

    queries: a condition on vec_id. A row is no neighbour of its own id. Rows without id, and vectors that are null, zero,
    of another length, or hold null or non-finite numbers take no part. Rows that repeat an id count each. With fewer
    rows than k all are returned; with none, no rows.
    """
    spark, s = table.sparkSession, settings
    rows = written(usable(table, vec_id, embedding, zeros=False), "vectors")
    sample = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.sample).select("v").toArrow().column("v"))
    fields = "query_id long, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit(sample, s)
    visits = calibrate(tree, sample, s)
    shared = spark.sparkContext.broadcast(tree)  # at most s.sample centres

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.assign(matrix(b.column(1))))], names=["vec_id", "v", "leaf"])

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = [[x for _, x in zip(range(visits), shared.value.visit(q))] for q in matrix(b.column(1))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves, pa.list_(pa.int64()))], names=["vec_id", "v", "leaves"])

    dealt = written(rows.mapInArrow(deal, "vec_id long, v array<double>, leaf long"), "leaves")
    asked = rows.filter(queries).mapInArrow(widen, "vec_id long, v array<double>, leaves array<long>").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode("leaves").alias("leaf"))
    asked = written(asked, "visits")
    # as many rows as the tree has leaves
    parts = F.ceil(F.col("n") / s.chunk).cast("int")
    row_parts = dealt.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf", parts.alias("row_parts"))
    query_parts = asked.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf", parts.alias("query_parts"))
    cuts = F.broadcast(row_parts.join(query_parts, "leaf"))
    part = lambda column, of: F.pmod(F.xxhash64(column), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = dealt.join(cuts, "leaf").withColumn("row_part", part("vec_id", "row_parts")).withColumn("query_part", each("query_parts"))
    right = asked.join(cuts, "leaf").withColumn("query_part", part("query_id", "query_parts")).withColumn("row_part", each("row_parts"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, x, out = a.column("vec_id").to_numpy(), matrix(a.column("v")), []
        if len(ids):
            for query, q in zip(b.column("query_id").to_pylist(), matrix(b.column("q"))):
                d = np.sqrt(((x - q) ** 2).sum(axis=1))
                other = np.flatnonzero(ids != query)
                if len(other) > 4 * s.k:  # all that may be among the k, ties included
                    other = other[d[other] <= np.partition(d[other], s.k - 1)[s.k - 1]]
                top = other[np.lexsort((ids[other], d[other]))][: s.k]
                out.append((np.full(len(top), query, dtype=np.int64), ids[top], d[top]))
        cols = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    keys = ["leaf", "row_part", "query_part"]
    found = left.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(right.select(*keys, "query_id", "q").groupBy(*keys)).applyInArrow(meet, fields)
    return best(found, s.k, largest=False)
