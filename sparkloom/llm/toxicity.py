"""Toxicity scores of a classifier that is regularised by counterfactuals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Group mentions; in a counterfactual each is swapped for another of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("blind", "deaf", "disabled", "old", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
_SWAP = {term: row[(i + 1) % len(row)] for row in IDENTITY_TERMS for i, term in enumerate(row)}
_WORD = re.compile(r"[^\W_]+")
_CACHE = 200_000


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled rows that are fitted on; nothing else is bounded.

    space: buckets of hashed features; prefixes: lengths of the word beginnings that are features beside words.
    min_positive, max_features: of the buckets, those in at least so many toxic rows, and the most telling of them.
    ridge, fairness: weights of the penalties on weights and on score changes of counterfactuals.
    """

    max_rows: int = 20_000
    space: int = 1 << 22
    prefixes: tuple[int, ...] = (3, 4, 5)
    min_positive: int = 4
    max_features: int = 4_096
    ridge: float = 3e-4
    fairness: float = 1.0
    steps: int = 400


class _Features:
    """Feature buckets of words, kept for words met before."""

    def __init__(self, settings: Settings):
        self.settings, self.known = settings, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        if (found := self.known.get(word)) is None:
            import xxhash

            s = self.settings
            names = [f"w:{word}", *(f"p:{word[:k]}" for k in s.prefixes if len(word) > k)]
            found = tuple(xxhash.xxh3_64_intdigest(x) % s.space for x in names)
            if len(self.known) >= _CACHE:
                self.known = {}
            self.known[word] = found
        return found

    def of(self, words: set[str]) -> set[int]:
        return {b for w in words for b in self.of_word(w)}


def words(text: str | None) -> set[str]:
    """Distinct words of a whole text, in lower case."""
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass(frozen=True)
class Model:
    settings: Settings
    bias: float
    weights: dict[int, float]

    def score(self, batches: Iterator[list[str | None]]) -> Iterator[np.ndarray]:
        features, own = _Features(self.settings), {}
        for texts in batches:
            out = []
            for text in texts:
                met: set[int] = set()
                for w in words(text):
                    if (ids := own.get(w)) is None:
                        ids = tuple(b for b in features.of_word(w) if b in self.weights)
                        if len(own) >= _CACHE:
                            own = {}
                        own[w] = ids
                    met.update(ids)
                out.append(self.bias + sum(self.weights[b] for b in met))
            yield 1 / (1 + np.exp(-np.clip(np.array(out, dtype=float), -40, 40)))


def _descend(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], n: int, s: Settings) -> tuple[float, np.ndarray]:
    """Weights of a logistic regression: log loss of balanced classes, ridge, and the mean squared change of the score
    between a text and its counterfactual, by full-batch Adam steps."""
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    moved = [np.concatenate([np.stack([a, np.ones(len(a))]), np.stack([b, -np.ones(len(b))])], axis=1) for a, b in pairs]
    change = np.concatenate(moved, axis=1) if moved else np.zeros((2, 0))
    change_at, change_by = change[0].astype(np.int64), change[1]
    change_of = np.repeat(np.arange(len(pairs)), [m.shape[1] for m in moved]) if moved else np.zeros(0, dtype=np.int64)
    positive = max(1, labels.sum())
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / max(1, len(labels) - positive))
    theta, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, s.steps + 1):
        z = theta[n] + np.bincount(of, weights=theta[flat], minlength=len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
        grad = np.append(np.bincount(flat, weights=g[of], minlength=n) + s.ridge * theta[:n], g.sum())
        if len(pairs):
            delta = np.bincount(change_of, weights=theta[change_at] * change_by, minlength=len(pairs))
            grad[:n] += 2 * s.fairness / len(pairs) * np.bincount(change_at, weights=delta[change_of] * change_by, minlength=n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[n]), theta[:n]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """A model of docs with labels (1: toxic).

    At most settings.max_rows labels are used: those with the smallest hashes of their key, so reruns agree. They are
    chosen before any text is read, and so few that they are broadcast: no text is shuffled. Features are made by the
    executors, written down and counted there; the driver gets those of the few thousand buckets that it fits weights for. Null labels and keys are left out.
    Without any toxic row, or any other, the model scores every text alike.
    """
    s = settings
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label"))
    few = known.orderBy(F.xxhash64("_key"), "_key", "label").limit(s.max_rows)
    chosen = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(few), "_key").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(s)
        for batch in batches:
            own, other = [], []
            for x in batch.column(1).to_pylist():
                have = words(x)
                own.append(np.array(sorted(features.of(have)), dtype="<i4").tobytes())
                swapped = {_SWAP.get(w, w) for w in have} if not have.isdisjoint(_SWAP) else None
                other.append(None if swapped is None else np.array(sorted(features.of(swapped)), dtype="<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(other, pa.binary())], names=["label", "own", "other"])

    made = written(chosen.mapInArrow(run, "label int, own binary, other binary"), "labelled")
    facts = made.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.lit(0), F.least(F.lit(1), "label"))), F.lit(0)).alias("toxic")).first()
    total, toxic = facts["n"], facts["toxic"]
    if toxic in (0, total):
        share = (toxic + 0.5) / (total + 1)
        return Model(s, float(np.log(share / (1 - share))) if total else -4.0, {})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pos = np.zeros(s.space, dtype=np.int64), np.zeros(s.space, dtype=np.int64)
        for batch in batches:
            for y, x in zip(batch.column("label").to_pylist(), batch.column("own").to_pylist()):
                own = np.frombuffer(x, dtype="<i4")
                seen[own] += 1
                if y > 0:
                    pos[own] += 1
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(seen[met]), pa.array(pos[met])], names=["bucket", "seen", "pos"])

    # counts of all buckets stay with the executors; the driver gets max_features of them at most
    sums = made.select("label", "own").mapInArrow(counted, "bucket long, seen long, pos long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("pos").alias("pos"))
    expected = F.col("seen") * toxic / total
    telling = sums.filter(F.col("pos") >= s.min_positive).withColumn("telling", (F.col("pos") - expected) / F.sqrt(expected + 1)).filter("telling > 3")
    kept = np.array(sorted(r["bucket"] for r in telling.orderBy(F.desc("telling"), "bucket").limit(s.max_features).collect()), dtype=np.int64)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(x: bytes | None) -> bytes | None:
            return None if x is None else np.flatnonzero(np.isin(kept, np.frombuffer(x, dtype="<i4"))).astype("<i4").tobytes()

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(map(places, batch.column(c).to_pylist()), pa.binary()) for c in ("own", "other"))], names=["label", "own", "other"])

    got = made.mapInArrow(held, "label int, own binary, other binary").limit(s.max_rows).toArrow()
    discard(made)
    read = lambda x: np.frombuffer(x.as_py(), dtype="<i4").astype(np.int64)
    own = [read(x) for x in got.column("own")]
    pairs = [(x, read(y)) for x, y in zip(own, got.column("other")) if y.is_valid]
    bias, theta = _descend(own, np.array(got.column("label").to_pylist(), dtype=np.int64).clip(0, 1), pairs, len(kept), s)
    return Model(s, bias, {int(k): float(w) for k, w in zip(kept, theta)})


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of every row, score (0 to 1) and predicted (1 if score >= threshold).

    A row at a time; the model has at most settings.max_features weights. Null and empty texts get the score of no word.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[str | None]]:
            for batch in batches:
                held.append(batch)
                yield batch.column(len(keep)).to_pylist()

        for found in model.score(texts()):
            batch = held.pop()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{fields}, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is never learned from: crc32 of its id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Learned from the rows of labels that are not held out.

    Null ids are held out. A doc_id with several labels counts as toxic if any of them says so; repeated rows are scored
    each; empty tables give no rows.
    """
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("label")).filter(~held_out(F.col("doc_id")))
    model = fit(docs, known, settings=settings)
    return score(docs, model, threshold=threshold).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")
