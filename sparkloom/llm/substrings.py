"""Removal of repeated word windows by a log-structured index of window fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_rank, in_filter, member_filter, partitions_for, shared_folder
from .jaccard import Words, mix

#: Bits of a word's place in its text; the others hold the document's number.
PLACE_BITS = 26
_PLACE = (1 << PLACE_BITS) - 1
#: Words that are hashed at once.
_GROUP_WORDS = 1_000_000
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


@dataclass(frozen=True)
class Settings:
    """window: words of a window. gram: words of the fingerprint's gram. batches: how many batches a whole table is fed
    in. max_runs: runs that are kept before they are compacted. filter_bits: size of the filters that executors get."""

    window: int = 20
    gram: int = 8
    batches: int = 3
    max_runs: int = 2
    filter_bits: int = 1 << 26


def _rolled(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hashes of every n consecutive words, doubled up from shorter ones."""
    out, have, step, length = None, 0, words, 1
    while n:
        if n & 1:
            if out is None:
                out, have = step, length
            else:  # what is there, then `length` words behind it
                m = len(step) - have
                out = out[: max(m, 0)] * np.uint64(pow(base, length, 1 << 64)) + step[have:] if m > 0 else out[:0]
                have += length
        n >>= 1
        if n:
            m = max(len(step) - length, 0)
            step = step[:m] * np.uint64(pow(base, length, 1 << 64)) + step[length : length + m]
            length *= 2
    return out


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive numbers."""
    length = 1
    while length * 2 <= n:
        x = np.minimum(x[:-length], x[length:]) if len(x) > length else x[:0]
        length *= 2
    rest = n - length
    return x if not rest else np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]


@dataclass
class _Hashed:
    """Windows of some texts, one after the other: doc (number of the text), start (word in it), fingerprint, anchor."""

    doc: np.ndarray
    start: np.ndarray
    fingerprint: np.ndarray
    anchor: np.ndarray
    words: np.ndarray
    at: np.ndarray

    def hashes(self, of: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows `of`."""
        return tuple(mix(_rolled(self.words, window, b)[self.at[of]]) for b in (_BASE, _OTHER))


def _windows(texts: list[np.ndarray], s: Settings) -> _Hashed:
    """A window's fingerprint is the hash of its least gram, the first of equals; its anchor is where that one starts.

    Equal windows have equal fingerprints, and windows of one anchor are not equal, since the anchor's place within them
    differs.
    """
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    words = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - s.window + 1, 0))
    starts = np.cumsum(sizes) - sizes
    many = np.maximum(sizes - s.window + 1, 0)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(starts, many) + start
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return _Hashed(none, none, none.astype(np.uint64), none, words, none)
    grams = mix(_rolled(words, s.gram, _BASE))
    # the order of grams by their upper bits, then by place: the least of a window is its first
    ordered = (grams & ~np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(ordered, s.window - s.gram + 1)[at] & np.uint64(_PLACE)).astype(np.int64)
    return _Hashed(doc, start, grams[anchor], anchor, words, at)


def _groups(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of batches and their texts' word hashes, of bounded size."""
    words = Words(lower=False)
    for batch in batches:
        first, found, total = 0, [], 0
        for i, x in enumerate(batch.column(text)):
            found.append(words.of(x.as_py()))
            total += len(found[-1])
            if total >= _GROUP_WORDS or i == batch.num_rows - 1:
                yield batch.slice(first, len(found)), found
                first, found, total = i + 1, [], 0


class SubstringIndex:
    """Sorted immutable runs of what earlier batches held.

    One list of runs holds fingerprints: fp, many (whether it was met more than once) and the document of the only
    occurrence. The other holds the windows, by two 64-bit hashes, of fingerprints met more than once. A run is a table
    bucketed and sorted by its key, so a batch is merge-joined without moving history. When there are max_runs runs they
    are compacted into one.
    """

    def __init__(self, spark: SparkSession, settings: Settings = Settings()):
        self.spark, self.settings = spark, settings
        self.prints: list[DataFrame] = []
        self.windows: list[DataFrame] = []
        self.past: DataFrame | None = None
        self._names: list[str] = []
        self._runs: dict[str, list[tuple[str, int]]] = {"prints": [], "windows": []}  # folders and buckets, as in the lists above

    def close(self) -> None:
        """Drops the runs' tables from the catalog; their files stay, and so do results that were planned before."""
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names = []

    def save(self, path: str) -> None:
        """Writes the manifest, from which open() finds the runs: kind, folder and buckets of each, as JSON rows."""
        rows = [(kind, k, *run) for kind, runs in self._runs.items() for k, run in enumerate(runs)]
        self.spark.createDataFrame(rows, "kind string, place int, path string, buckets int").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, past: DataFrame, settings: Settings = Settings()) -> SubstringIndex:
        """The index of a saved manifest, in any later session. past: doc and text of all documents added so far."""
        index = cls(spark, settings)
        index.past = past.select("doc", "text")
        columns = {"prints": ("fp BIGINT, many BOOLEAN, doc BIGINT, again BIGINT", "fp"), "windows": ("h1 BIGINT, h2 BIGINT, place BIGINT", "h1, h2")}
        for row in spark.read.schema("kind string, place int, path string, buckets int").json(path).orderBy("kind", "place").collect():  # at most max_runs of each kind
            name, (fields, keys) = f"sparkloom_{row['kind']}_{uuid.uuid4().hex}", columns[row["kind"]]
            spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {row['buckets']} BUCKETS LOCATION '{row['path']}'")
            index._names.append(name)
            index._runs[row["kind"]].append((row["path"], row["buckets"]))
            table = spark.table(name)
            (index.prints if row["kind"] == "prints" else index.windows).append(table.drop("again"))
        return index

    def _run(self, df: DataFrame, keys: list[str], label: str) -> DataFrame:
        name = f"sparkloom_{label}_{uuid.uuid4().hex}"
        self._names.append(name)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt, path = df.repartition(buckets, *keys), f"{shared_folder(self.spark)}/sparkloom/{name}"
        dealt.write.option("path", path).option("compression", "zstd").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
        self._runs[label].append((path, buckets))
        return self.spark.table(name)

    def _compact(self) -> None:
        if len(self.prints) >= self.settings.max_runs:
            whole = self.prints[0]
            for run in self.prints[1:]:
                whole = whole.unionByName(run)
            self._runs["prints"] = []
            self.prints = [self._run(whole.groupBy("fp").agg(F.max("many").alias("many"), F.min("doc").alias("doc")), ["fp"], "prints")]
        if len(self.windows) >= self.settings.max_runs:
            whole = self.windows[0]
            for run in self.windows[1:]:
                whole = whole.unionByName(run)
            self._runs["windows"] = []
            self.windows = [self._run(whole, ["h1", "h2"], "windows")]

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (doc long, text, others; every doc above those added before) and returns its other columns with
        n_words, n_removed, kept: the words of no window that starts earlier in this batch or in those before."""
        s, key = self.settings, self.settings.filter_bits
        self._compact()

        def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in _groups(batches, "text"):
                w = _windows(texts, s)
                new = np.r_[True, (w.anchor[1:] != w.anchor[:-1]) | (w.doc[1:] != w.doc[:-1])] if len(w.doc) else np.zeros(0, dtype=bool)
                docs = part.column("doc").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(w.fingerprint[new].view(np.int64)), pa.array(docs[w.doc[new]])], names=["fp", "doc"])

        met = batch.select("doc", "text").mapInArrow(prints, "fp long, doc long").groupBy("fp").agg(F.count("*").alias("n"), F.min("doc").alias("doc"))
        once, many = F.lit(None).cast("long"), F.lit(False)
        for i, run in enumerate(self.prints):
            run = run.select("fp", F.col("many").alias(f"many{i}"), F.col("doc").alias(f"doc{i}"))
            met = met.join(run.hint("merge"), "fp", "left")
            once, many = F.coalesce(F.col(f"doc{i}"), once), many | F.coalesce(F.col(f"many{i}"), F.lit(False))
        state = met.select("fp", "doc", (F.col("n") > 1).alias("twice"), once.alias("seen"), many.alias("was"))
        run = self._run(state.withColumn("many", F.col("twice") | F.col("seen").isNotNull()).select("fp", "many", F.coalesce("seen", "doc").alias("doc"), F.when(~F.col("was"), F.col("seen")).alias("again")), ["fp"], "prints")
        repeated = member_filter(run.filter("many"), "fp", key)

        def emit(batches: Iterator[pa.RecordBatch], prints, docs=None) -> Iterator[pa.RecordBatch]:
            def wanted() -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b if docs is None else b.filter(pa.array(in_filter(docs.value, b.column("h").to_numpy().view(np.uint64))))

            for part, texts in _groups(wanted(), "text"):
                w = _windows(texts, s)
                of = np.flatnonzero(in_filter(prints.value, w.fingerprint))
                h1, h2 = w.hashes(of, s.window) if len(of) else (np.zeros(0, dtype=np.uint64),) * 2
                place = (part.column("doc").to_numpy()[w.doc[of]] << PLACE_BITS) | w.start[of]
                for a in range(0, len(of), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 50_000].view(np.int64)) for x in (h1, h2, place)], names=["h1", "h2", "place"])

        fields = "h1 long, h2 long, place long"
        found = batch.select("doc", "text").mapInArrow(lambda b: emit(b, repeated), fields)
        if self.past is not None:  # fingerprints that were met once before: their document is read again
            again = run.filter(F.col("again").isNotNull())
            prints_again = member_filter(again, "fp", key)
            docs_again = member_filter(again.select(F.xxhash64("again").alias("h")), "h", key // 4)
            history = self.past.select("doc", "text", F.xxhash64("doc").alias("h"))
            found = found.unionByName(history.mapInArrow(lambda b: emit(b, prints_again, docs_again), fields))
        first = found.groupBy("h1", "h2").agg(F.min("place").alias("place"))
        for known in self.windows:
            first = first.join(known.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        window_run = self._run(first, ["h1", "h2"], "windows")

        own = window_run.select(F.shiftright("place", PLACE_BITS).alias("doc"), F.col("place").bitwiseAND(F.lit(_PLACE)).cast("int").alias("start"))
        kept = own.groupBy("doc").agg(F.collect_list("start").alias("firsts"))  # of one document
        keep = [c for c in batch.columns if c not in ("doc", "text")]
        fields = ", ".join(f"`{c}` {batch.schema[c].dataType.simpleString()}" for c in keep)

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in _groups(batches, "text"):
                w = _windows(texts, s)
                drop = in_filter(repeated.value, w.fingerprint)
                edges = np.searchsorted(w.doc, np.arange(len(texts) + 1))
                n, removed, out = [], [], []
                for i, (firsts, text) in enumerate(zip(part.column("firsts"), part.column("text").to_pylist())):
                    lost = drop[edges[i] : edges[i + 1]].copy()
                    if firsts.is_valid:
                        at = firsts.values.to_numpy()
                        lost[at[at < len(lost)]] = False
                    covered = np.zeros(len(texts[i]) + 1, dtype=np.int64)
                    at = np.flatnonzero(lost)
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + s.window, -1)
                    gone = np.cumsum(covered)[:-1] > 0
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    n.append(len(words))
                    removed.append(int(gone.sum()))
                    out.append(b" ".join([x for x, g in zip(words, gone.tolist()) if not g] if removed[-1] else words))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.binary())], names=[*keep, "n_words", "n_removed", "kept"])

        done = batch.join(kept, "doc", "left").drop("doc").mapInArrow(finish, f"{fields}, n_words long, n_removed long, kept binary")
        self.prints.append(run.select("fp", "many", "doc"))
        self.windows.append(window_run)
        seen = batch.select("doc", "text")
        self.past = seen if self.past is None else self.past.unionByName(seen)
        return done.withColumn("kept", F.col("kept").cast("string"))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id (or the columns `keep`), n_words, n_removed, kept (the kept words joined by single blanks).

    A word goes if a window of settings.window words covers it that also starts earlier: in a document with a smaller
    doc_id, or earlier in its own. The table is fed to a SubstringIndex in batches of ascending doc_id.

    Only a fingerprint per anchor is shuffled for every text, about one for every seven words; window hashes only for
    fingerprints that come again. Equal windows are told by 128 bits of hashes over all their words. Executors get
    filters of fixed size; false hits cost rows, not results. Null, empty and short texts lose nothing. Rows that share
    a doc_id are read as one document with common starts. Rows without a doc_id come after all others. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    keep = keep or (doc_id,)
    held = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *held)
    row = source.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    integral = source.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if integral and row["n"] == row["known"] and (not row["n"] or row["low"] >= 0 and row["high"] < 1 << (63 - PLACE_BITS)):
        numbered = source.withColumn("doc", F.col("doc_id").cast("long"))
    else:  # ids that don't fit beside a place are replaced by their rank
        ids = source.select("doc_id").distinct()
        ranks = global_rank(ids, [F.col("doc_id").isNull(), F.col("doc_id")], partitions_for(row["n"], 500_000, 4)).withColumn("doc", F.col("rank").cast("long")).withColumnRenamed("doc_id", "_id")
        numbered = source.join(ranks, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "rank")
    numbered = numbered.drop("doc_id")
    cuts = numbered.agg(F.percentile_approx("doc", F.array(*[F.lit(k / settings.batches) for k in range(1, settings.batches)]), 1000).alias("c")).first()["c"] if settings.batches > 1 else []
    index, out, below = SubstringIndex(spark, settings), None, None
    for above in [*sorted(set(cuts or [])), None]:
        here = numbered
        if below is not None:
            here = here.filter(F.col("doc") > below)
        if above is not None:
            here = here.filter(F.col("doc") <= above)
        done = index.add(here)
        out, below = done if out is None else out.unionByName(done), above
    index.close()
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "n_words", "n_removed", "kept")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept text."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: DuckDB SQL for op10's rows.
WINDOW_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(ws[s + 1 : s + 20], ' ') AS x FROM w, unnest(range(0, len(ws) - 19)) AS t(s)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM windows) WHERE k > 1
), gone AS (
  SELECT doc_id, list(DISTINCT s + o) AS g FROM later, unnest(range(0, 20)) AS u(o) GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(g), 0) AS r,
         array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(g, []), i - 1)), ' ') AS k
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM kept
"""
