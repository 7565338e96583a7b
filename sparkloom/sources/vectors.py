"""A store of vectors as Parquet by cell: product-quantised codes are read first, vectors of the few that may count later."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plan:
    """cells: parts of the store. pieces: parts of a vector that are coded apart, with `codes` values each. sample: rows on
    which both are fitted; all rows are stored."""

    cells: int = 64
    pieces: int = 8
    codes: int = 64
    sample: int = 20_000
    rounds: int = 12


def _means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centres of rows, by Lloyd's rounds; fewer if there are fewer different rows."""
    x = np.unique(x, axis=0) if len(x) <= k else x
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)


def _units(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and which rows have one: finite, not 0, of the store's width."""
    rows = [np.asarray(v, dtype=np.float64) if v is not None and None not in v else None for v in column.to_pylist()]
    good = np.array([v is not None and len(v) == (width or len(v)) and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any()) for v in rows], dtype=bool)
    x = np.array([v for v, g in zip(rows, good) if g]) if good.any() else np.zeros((0, width or 1))
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True)) if len(x) else x, good


class VectorStore:
    """Vectors by key in a folder that all machines see.

    A row is in the cell of its nearest centre; its code names the nearest centre of each piece of what is left, and its
    error is how far the coded vector is from it. For a query, a cell's centre and radius, and a row's code and error, bound
    its cosine from above: so a search reads the cells that may count, their codes, and the vectors that may count, and is
    exact. With `probes` it reads the nearest cells only, and is approximate. Rows are added at any time, in any session.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        held = spark.read.parquet(f"{self.folder}/model").first()
        self.plan, self.kind = Plan(**json.loads(held["plan"])), held["kind"]
        self.width, matrix = held["width"], lambda name, *shape: np.array(held[name]).reshape(*shape)
        self.centres = matrix("centres", -1, self.width)
        self.edges = [int(e) for e in held["edges"]]
        flat = np.array(held["books"])
        self.books, at = [], 0
        for a, b, n in zip(self.edges[:-1], self.edges[1:], held["sizes"]):
            self.books.append(flat[at : at + n * (b - a)].reshape(n, b - a))
            at += n * (b - a)

    @classmethod
    def create(cls, rows: DataFrame, folder: str, key: str = "vec_id", vector: str = "embedding", plan: Plan = Plan()) -> VectorStore:
        """A new store, fitted on a sample of rows and filled with all of them."""
        spark = rows.sparkSession
        sample = rows.filter(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(key), key).limit(plan.sample).toArrow()  # Plan.sample rows
        widths = [len(v) for v in sample.column(0).to_pylist()]
        width = max(set(widths), key=lambda w: (widths.count(w), w)) if widths else 1
        x, _ = _units(sample.column(0), width)
        x = x if len(x) else np.zeros((1, width))
        centres = _means(x, plan.cells, plan.rounds, 1)
        rest = x - centres[_nearest(x, centres)]
        edges = np.linspace(0, width, min(plan.pieces, width) + 1).astype(int).tolist()
        books = [_means(rest[:, a:b], plan.codes, plan.rounds, 2) for a, b in zip(edges[:-1], edges[1:])]
        kind = rows.schema[key].dataType.simpleString()
        model = (json.dumps(asdict(plan)), kind, width, centres.ravel().tolist(), edges, [len(b) for b in books], np.concatenate([b.ravel() for b in books]).tolist())
        shape = "plan string, kind string, width int, centres array<double>, edges array<int>, sizes array<int>, books array<double>"
        spark.createDataFrame([model], shape).coalesce(1).write.parquet(f"{folder.rstrip('/')}/model")
        store = cls(spark, folder)
        store.add(rows, key, vector)
        return store

    def add(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
        """Adds rows; null, zero and non-finite vectors, those of another length and null keys have no place in a store."""
        width, centres, books, edges, batch = self.width, self.centres, self.books, self.edges, uuid.uuid4().hex

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                x, good = _units(part.column(1), width)
                cell = _nearest(x, centres) if len(x) else np.zeros(0, dtype=np.int64)
                rest = x - centres[cell]
                code = np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(edges[:-1], edges[1:], books)], axis=1) if len(x) else np.zeros((0, len(books)), dtype=np.int64)
                near = centres[cell] + np.concatenate([book[code[:, k]] for k, book in enumerate(books)], axis=1) if len(x) else x
                far = np.sqrt((rest**2).sum(axis=1))
                error = np.sqrt(((x - near) ** 2).sum(axis=1))
                kept = part.filter(pa.array(good))
                codes = pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), codes, pa.array(error), pa.array(far), pa.array(cell.astype(np.int32))], names=["key", "vector", "code", "error", "far", "cell"])

        taken = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
        shape = f"key {self.kind}, vector array<double>, code binary, error double, far double, cell int"
        done = taken.mapInArrow(coded, shape).withColumn("batch", F.lit(batch))
        # a cell is split over tasks, however many rows it has
        done.write.partitionBy("cell").mode("append").parquet(f"{self.folder}/rows")
        radius = self.rows().filter(F.col("batch") == batch).groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        radius.coalesce(1).write.mode("append").parquet(f"{self.folder}/radii")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"key {self.kind}, vector array<double>, code binary, error double, far double, batch string, cell int").parquet(f"{self.folder}/rows")

    def cells(self) -> list[tuple[int, float, int]]:
        """cell, radius and rows: a row for each cell at most."""
        held = self.spark.read.schema("cell int, radius double, n long").parquet(f"{self.folder}/radii")
        return [tuple(r) for r in held.groupBy("cell").agg(F.max("radius"), F.sum("n")).collect()]

    def _codes(self, q: np.ndarray, cells: list[int]) -> DataFrame:
        """key, cell, near (the cosine of the coded vector) and most (a bound of the row's) of some cells; no vector is read."""
        tables = [book @ q[a:b] for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books)]
        base = self.centres @ q

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                code = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                near = base[part.column(3).to_numpy()] + sum(t[code[:, k]] for k, t in enumerate(tables)) if part.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(near), pa.array(near + part.column(2).to_numpy())], names=["key", "cell", "near", "most"])

        return self.rows().filter(F.col("cell").isin(cells)).select("key", "code", "error", "cell").mapInArrow(scored, f"key {self.kind}, cell int, near double, most double")

    def search(self, query: list[float], k: int, least: float = 0.55, probes: int | None = None, refine: int = 16) -> DataFrame:
        """key, cosine of the k rows most like a query, at `least` or above, best first, ties to the smaller key.

        Exact without probes: the k best coded rows give a kth cosine; then only the cells, and of those the rows, whose bound
        reaches it are compared by their vectors. With probes, the refine * k best coded rows of that many cells are.
        """
        q = np.asarray(query, dtype=np.float64)
        empty = self.spark.createDataFrame([], f"key {self.kind}, cosine double")
        if len(q) != self.width or not np.isfinite(q).all() or not q.any():
            return empty
        q = q / np.sqrt((q**2).sum())
        held = self.cells()
        order = sorted(held, key=lambda c: -float(self.centres[c[0]] @ q))
        if not order:
            return empty
        few = [c for c, _, _ in order[: probes or max(1, len(order) // 8)]]
        best = self._codes(q, few).orderBy(F.desc("near"), "key").limit(k if probes is None else refine * k)
        first = self._exact(q, best).orderBy(F.desc("cosine"), "key").limit(k)
        if probes is not None:
            return first.filter(F.col("cosine") >= least)
        found = [r["cosine"] for r in first.collect()]  # k numbers
        floor = max(least, min(found) if len(found) == k else -2.0) - 1e-9
        may = [c for c, radius, _ in held if float(self.centres[c] @ q) + radius >= floor]
        return self._exact(q, self._codes(q, may).filter(F.col("most") >= floor)).filter(F.col("cosine") >= least).orderBy(F.desc("cosine"), "key").limit(k)

    def _exact(self, q: np.ndarray, wanted: DataFrame) -> DataFrame:
        unit = F.array(*[F.lit(float(x)) for x in q])
        dot = F.aggregate(F.zip_with("vector", unit, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, b: a + b * b))
        # cells prune the scan when it runs; the keys choose rows
        return self.rows().select("key", "cell", "vector").join(wanted.select("key", "cell").distinct(), ["cell", "key"], "left_semi").select("key", (dot / norm).alias("cosine"))
