"""Ranked lexical search: a clustered index over documents in the order of a graph bisection, with exact stopping."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .bisection import Splitter, bisected
from .common import discard, partitions_for, written

#: Bytes of terms: A-Z as a-z, other letters and digits and all beyond ASCII as they are; the rest parts them.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """k: results of an item. items, terms: of a block of items that is searched together, at most. shard: documents of
    one row of the index. cluster: documents, after reordering, that share bounds. sample: documents on which the upper
    cuts of the bisection are fitted, and levels: how many cuts."""

    k: int = 10
    items: int = 2_000
    terms: int = 20_000
    shard: int = 4_096
    cluster: int = 64
    sample: int = 8_192
    levels: int = 6


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Scores of postings, in whole numbers."""
    m = 10 + 90 * n * n_docs // max(1, total)
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Shard:
    """Documents in clusters of neighbours, with postings by term and the largest impact of each term in each cluster."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, cluster: int):
        """doc, term, impact: postings sorted by term and document."""
        self.ids, self.doc, self.impact, self.cluster = ids, doc, impact, cluster
        self.terms, first = np.unique(term, return_index=True)
        self.clusters = -(-len(ids) // cluster)
        cell = np.repeat(np.arange(len(self.terms)), np.diff(np.r_[first, len(term)])) * self.clusters + doc // cluster
        self.edge = np.searchsorted(cell, np.arange(len(self.terms) * self.clusters + 1))  # of (term, cluster)
        most = np.zeros(len(self.terms) * self.clusters, dtype=np.int64)
        np.maximum.at(most, cell, impact)
        self.most = most.reshape(len(self.terms), self.clusters)

    def search(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents of a score of at least floor, ties to the smaller id, exactly.

        Clusters are visited by their bounds, the sums of their largest impacts, until a bound is below the kth score.
        """
        at = np.flatnonzero(np.isin(self.terms, terms))
        bounds = self.most[at].sum(axis=0)
        order = np.argsort(-bounds, kind="stable")
        ids, scores, step, seen = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 2, 0
        while seen < len(order) and bounds[order[seen]] >= max(floor, 1):
            part = order[seen : seen + step]
            part = part[bounds[part] >= max(floor, 1)]
            acc = np.zeros((len(part), self.cluster), dtype=np.int64)
            for row, c in enumerate(part.tolist()):
                cells = at * self.clusters + c
                for a, b in zip(self.edge[cells].tolist(), self.edge[cells + 1].tolist()):
                    if a < b:
                        acc[row, self.doc[a:b] - c * self.cluster] += self.impact[a:b]
            row, place = np.nonzero(acc >= max(floor, 1))
            ids, scores = np.r_[ids, self.ids[part[row] * self.cluster + place]], np.r_[scores, acc[row, place]]
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                floor = max(floor, int(scores[-1]))
            seen, step = seen + step, 2 * step
        return ids, scores


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest score above 0, ties to the smaller doc_id.

    Items are searched in blocks of bounded size, against all documents; a block's terms, and only these, are indexed. The
    upper cuts of a recursive graph bisection are fitted on a documented number of documents and sort all into parts,
    whose order is cut into shards; each shard is bisected on down to clusters of neighbours. A shard's bound for an item
    sums the largest impacts of its terms there. Each item first visits the shard with its highest bound; then all those
    whose bound reaches its kth score so far. Within a shard, clusters are visited by their bounds until one is below the
    kth score. Scores are whole numbers, so results do not hang on the order; ids break ties, not places.

    Null texts have no terms. Rows without doc_id count in the statistics but are no results; rows that repeat an id are
    ranked each, and so are rows that repeat an item. Items without a matching term give no rows, nor does an empty table.
    """
    s, spark = settings, docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    kind = asked.schema["item_id"].dataType
    shape = f"item_id {kind.simpleString()}, rank int, doc_id long, score long"
    found = None
    for block in _blocks(asked, s):
        part = _ranked(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")), block, s)
        names = spark.createDataFrame([(i, one) for i, (one, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        part = part.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # one row for each of the block's items
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], shape)


def _blocks(items: DataFrame, s: Settings) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their distinct terms, so many at once as a block holds."""
    block, terms = [], set()
    for row in items.toLocalIterator(prefetchPartitions=True):
        own = sorted(set(terms_of(bytes(row["text"]) if row["text"] is not None else None)))
        if block and (len(block) == s.items or len(terms | set(own)) > s.terms):
            yield block
            block, terms = [], set()
        block.append((row["item_id"], own))
        terms |= set(own)
    if block:
        yield block


def _edges(table: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc (place in the table), term, tf of rows with arrays."""
    whole = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
    terms, tfs = whole.column("terms").combine_chunks(), whole.column("tfs").combine_chunks()
    sizes = np.diff(terms.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)


def _ranked(docs: DataFrame, block: list[tuple[object, list[bytes]]], s: Settings) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
    wanted = [np.array([vocabulary[t] for t in own], dtype=np.int64) for _, own in block]
    shared = spark.sparkContext.broadcast(vocabulary)  # Settings.terms of them at most, or one item's

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for data in batch.column(1):
                words = terms_of(data.as_py())
                own = Counter(map(get, words))
                own.pop(None, None)
                sizes.append(len(words))
                terms.append(list(own.keys()))
                tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    rows = written(docs.mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<int>"), "terms")
    n_docs, total = (x or 0 for x in rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first())
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each of the block's terms
        df[r["term"]] = r["count"]
    w = np.array([weight(n_docs, int(x)) if x else 0 for x in df], dtype=np.int64)
    use = rows.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
    sample = use.select("doc_id", "terms", "tfs").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample).toArrow()
    at, term, _ = _edges(sample)
    splitter = spark.sparkContext.broadcast(Splitter(at, term, sample.num_rows, len(vocabulary), s.levels))  # 2^levels * terms numbers

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, term, _ = _edges(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(splitter.value.leaves(at, term, batch.num_rows).astype(np.int32))], names=[*batch.schema.names, "leaf"])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, number = [], 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, s.shard):
                piece = batch.slice(i, s.shard)
                if size + piece.num_rows > s.shard and held:
                    yield one(pa.Table.from_batches(held), (TaskContext.get().partitionId() << 32) + number)
                    held, size, number = [], 0, number + 1
                held.append(piece)
                size += piece.num_rows
        if held:
            yield one(pa.Table.from_batches(held), (TaskContext.get().partitionId() << 32) + number)

    def one(table: pa.Table, shard: int) -> pa.RecordBatch:
        at, term, tf = _edges(table)
        order, _ = bisected(at, term, table.num_rows, len(w), max(0, math.ceil(math.log2(max(1, table.num_rows / s.cluster)))))
        place = np.empty(table.num_rows, dtype=np.int64)
        place[order] = np.arange(table.num_rows)
        impact = impacts(w[term], tf, table.column("n").to_numpy()[at], n_docs, total)
        at = place[at]
        by = np.lexsort((at, term))
        ids, at, term, impact = table.column("doc_id").to_numpy()[order], at[by], term[by], impact[by]
        terms, first = np.unique(term, return_index=True)
        return pa.RecordBatch.from_pylist([{
            "shard": shard, "ids": ids, "docs": at.astype(np.int32), "of": term.astype(np.int32), "impacts": impact,
            "terms": terms, "most": np.maximum.reduceat(impact, first)}], schema=to_arrow_schema(index_shape))

    many = lambda kind: T.ArrayType(kind)
    index_shape = T.StructType([T.StructField(c, t) for c, t in (("shard", T.LongType()), ("ids", many(T.LongType())), ("docs", many(T.IntegerType())), ("of", many(T.IntegerType())), ("impacts", many(T.LongType())), ("terms", many(T.IntegerType())), ("most", many(T.LongType())))])
    placed = use.mapInArrow(sorted_out, "doc_id long, n long, terms array<int>, tfs array<int>, leaf int")
    ranges = partitions_for(use.count(), s.shard)
    index = written(placed.repartitionByRange(ranges, "leaf", "doc_id").sortWithinPartitions("leaf", "doc_id").mapInArrow(indexed, index_shape), "index")
    discard(rows)

    # a row for each item and shard that have a term in common
    ask = spark.createDataFrame([(int(t), i) for i, own in enumerate(wanted) for t in own.tolist()], "term int, item int")
    bounds = index.select("shard", F.explode(F.arrays_zip("terms", "most")).alias("x")).select("shard", F.col("x.terms").alias("term"), F.col("x.most").alias("most"))
    bounds = written(bounds.join(ask, "term").groupBy("item", "shard").agg(F.sum("most").alias("bound")).filter("bound > 0"), "bounds")
    first = bounds.groupBy("item").agg(F.max(F.struct("bound", F.col("shard"))).alias("x")).select("item", F.col("x.shard").alias("shard"), F.lit(1).cast("long").alias("floor"))

    def visit(pairs: DataFrame) -> DataFrame:
        by_shard = pairs.groupBy("shard").agg(F.collect_list(F.struct("item", "floor")).alias("asked"))  # Settings.items at most
        return index.select("shard", "ids", "docs", "of", "impacts").join(by_shard, "shard").select("ids", "docs", "of", "impacts", "asked").mapInArrow(searched, "item int, doc_id long, score long")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, at, term, impact = (batch.column(c)[k].values.to_numpy().astype(np.int64) for c in range(4))
                shard = Shard(ids, at, term, impact, s.cluster)
                out = [(x["item"], *shard.search(wanted[x["item"]], s.k, x["floor"])) for x in batch.column(4)[k].as_py()]
                cols = [np.repeat([i for i, _, _ in out], [len(d) for _, d, _ in out]).astype(np.int32), np.concatenate([d for _, d, _ in out]), np.concatenate([x for _, _, x in out])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["item", "doc_id", "score"])

    def best(df: DataFrame) -> DataFrame:
        """k rows of each item: k of each shard meet."""
        from pyspark.sql import Window

        return df.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= s.k)

    begun = written(visit(first), "first")
    floors = begun.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("kth")).select("item", F.when(F.col("n") == s.k, F.col("kth")).otherwise(1).cast("long").alias("floor"))
    rest = bounds.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1))).filter(F.col("bound") >= F.col("floor"))
    rest = rest.join(first.select("item", "shard"), ["item", "shard"], "left_anti").select("item", "shard", "floor")
    return best(begun.unionByName(visit(rest)))


#: DuckDB SQL for op12's rows.
RANK_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), d AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM t WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY term
), s AS (
  SELECT q.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * p.n * docs) // l)))) AS BIGINT) AS score
  FROM q JOIN p ON q.term = p.term JOIN w ON w.term = p.term, total GROUP BY q.item_id, p.doc_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
