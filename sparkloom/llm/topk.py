"""Exact top-k by inner product with block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, written
from .vectors import best, matrix, usable


@dataclass(frozen=True)
class Settings:
    """block: rows of a document range. shard: rows, and batch: queries, that meet in one task. step: blocks that are
    scored before bounds are looked at again. planes: hyperplanes whose sides order the rows."""

    k: int = 5
    block: int = 64
    shard: int = 16_384
    batch: int = 1_024
    step: int = 8
    planes: int = 10
    scale: int = 256


def _cells(x: np.ndarray, planes: int) -> np.ndarray:
    """A number for the side of fixed random hyperplanes that each row lies on."""
    normals = np.random.default_rng(11).standard_normal((x.shape[1], planes))
    return ((x @ normals > 0) * (1 << np.arange(planes))).sum(axis=1)


def search(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top-k of every query among rows x, exactly, with ties to the smaller id.

    Rows are cut into ranges; a range keeps the maxima and minima of each term. Its bound for a query sums the larger of
    the query's products with them. Ranges are scored in the order of their bounds until a bound is below the kth score.
    """
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, x.shape[1]) < 2.0**53
    kind = np.float64 if exact else np.int64  # whole numbers are exact in either
    x, queries = x.astype(kind), queries.astype(kind)
    starts = np.arange(0, len(x), s.block)
    most, least = np.maximum.reduceat(x, starts, axis=0), np.minimum.reduceat(x, starts, axis=0)
    bounds = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    out = []
    for q, own, bound, blocks in zip(queries, query_ids.tolist(), bounds, order):
        top_score, top_id = np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64)
        for at in range(0, len(blocks), s.step):
            if len(top_id) == s.k and bound[blocks[at]] < top_score[-1]:
                break
            rows = (starts[blocks[at : at + s.step], None] + np.arange(s.block)).ravel()
            rows = rows[rows < len(x)]
            score, found = x[rows] @ q, ids[rows]
            keep = found != own
            if len(top_id) == s.k:
                keep &= score >= top_score[-1]
            score, found = np.r_[top_score, score[keep]], np.r_[top_id, found[keep]]
            first = np.lexsort((found, -score))[: s.k]
            top_score, top_id = score[first], found[first]
        out.append((np.full(len(top_id), own, dtype=np.int64), top_id, top_score.astype(np.int64)))
    cols = [np.concatenate(c) for c in zip(*out)]
    return tuple(cols) if cols else (np.zeros(0, dtype=np.int64),) * 3


def top_k(table: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * x), exactly.

    Rows are ordered by the sides of a few hyperplanes they lie on, then by id, and cut into shards of document ranges.
    Queries are cut into batches; every batch meets every shard, once, in a task of bounded size, which prunes ranges by
    their bounds; a query's best of all shards are then ranked. What is read grows with rows times query batches, as
    exact search must.

    queries: a condition on vec_id. A row is no candidate of its own id. Rows without id, and vectors that are null, of
    another length, or hold null or non-finite numbers take no part. Rows that repeat an id count each. An empty table
    gives no rows.
    """
    s = settings

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(s.scale * matrix(b.column(1)))
            cells = _cells(x, s.planes) if len(x) else np.zeros(0, dtype=np.int64)
            terms = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * (x.shape[1] if len(x) else 0), pa.int32()), pa.array(x.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), terms, pa.array(cells.astype(np.int64))], names=["vec_id", "terms", "cell"])

    rows = written(usable(table, vec_id, embedding, zeros=True).mapInArrow(place, "vec_id long, terms array<long>, cell long"), "terms")
    asked = rows.filter(queries)
    n, m = rows.count(), asked.count()
    shards, batches = partitions_for(n, s.shard), partitions_for(m, s.batch)
    dealt = written(rows.repartitionByRange(shards, "cell", "vec_id").sortWithinPartitions("cell", "vec_id").withColumn("shard", F.spark_partition_id()), "shards")
    left = dealt.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    right = asked.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(batches)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            found = (np.zeros(0, dtype=np.int64),) * 3
        else:
            a = a.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
            whole = lambda t: t.column("terms").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            found = search(whole(a), a.column("vec_id").to_numpy(), whole(b), b.column("query_id").to_numpy(), s)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    keys = ["shard", "batch"]
    met = left.select(*keys, "cell", "vec_id", "terms").groupBy(*keys).cogroup(right.select(*keys, F.col("vec_id").alias("query_id"), "terms").groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    return best(met, s.k, largest=True)


#: DuckDB SQL for op3's rows.
TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
