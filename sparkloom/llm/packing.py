"""Packing token sequences: sum of squares, in many groups, with a second round over what is left open."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, written
from .tokenizing import encoder

CAPACITY, END = 4096, 1
#: Pieces that are packed together in one task.
GROUP_PIECES = 20_000
#: Sequences with at least this gap are packed again, as items, in the second round.
OPEN_GAP = 8
#: Share of sequences above the least number possible from which a group's packing is repaired.
EXCESS = 0.002


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given, and the bins' fill.

    open[g] counts the open bins with gap g. An item goes where the sum of open[g]^2 becomes smallest: into a bin of gap g
    the sum changes by 2 * (open[g - s] - open[g] + 1), with 1 less for each gap 0, and by 2 * open[capacity - s] + 1 for a
    new bin. Ties go to the smallest gap, a new bin last.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    stacks: dict[int, list[int]] = {}
    bins, offsets, fill = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), []
    for i, size in enumerate(lengths.tolist()):
        here = count[size:]
        cost = 2 * (count[: capacity + 1 - size] - here + 1)
        cost[0] = 1 - 2 * here[0]
        cost = np.where(here > 0, cost, np.iinfo(np.int64).max)
        gap = int(cost.argmin())
        if cost[gap] <= (2 * count[capacity - size] + 1 if size < capacity else 0):
            gap += size
            which = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, which = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = which, fill[which]
        fill[which] += size
        if gap > size:
            count[gap - size] += 1
            stacks.setdefault(gap - size, []).append(which)
    return bins, offsets, np.array(fill, dtype=np.int64)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given, and the bins' fill: an item goes into the smallest gap that holds it."""
    count, stacks, sums = np.zeros(capacity + 1, dtype=np.int64), {}, []
    where, at = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i, size in enumerate(lengths.tolist()):
        gap = size + int((count[size:] > 0).argmax())
        if count[gap]:
            which = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, which = capacity, len(sums)
            sums.append(0)
        where[i], at[i] = which, sums[which]
        sums[which] += size
        count[gap - size] += gap > size
        stacks.setdefault(gap - size, []).append(which)
    return where, at, np.array(sums, dtype=np.int64)


def repaired(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, fill: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same packing, or one of fewer bins where it is EXCESS above what the items' sum and the items over half a bin need.

    The items of bins with a gap of OPEN_GAP or more are taken out and put back, longest first, by best_fit. Where that is
    not enough, those of bins with many items are too, whose short items fill gaps: with four or more, three, two.
    """
    least = max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))
    many = np.bincount(bins, minlength=len(fill))
    for items_of in (capacity + 1, 4, 3, 2):
        if len(fill) <= least + EXCESS * least:
            break
        loose = (fill <= capacity - OPEN_GAP) | (many >= items_of)
        items = np.flatnonzero(loose[bins])
        items = items[np.argsort(-lengths[items], kind="stable")]
        where, at, sums = best_fit(lengths[items], capacity)
        if len(sums) < loose.sum():
            bins, offsets = (np.cumsum(~loose) - 1)[bins], offsets.copy()
            bins[items], offsets[items] = (~loose).sum() + where, at
            fill = np.r_[fill[~loose], sums]
            many = np.bincount(bins, minlength=len(fill))
    return bins, offsets, fill


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, row, piece, start, length, ids_crc32, and the ids where wanted.

    A document is its tokens and then `end`, cut every `capacity` ids. Null or empty text is the one id `end`. Rows that
    repeat a doc_id are documents of their own; `row` tells them apart.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tail = encoder(tokenizer), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                source, out = [], []
                for i, ids in enumerate(known.encode(part.column(2).to_pylist())):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        source.append(i)
                        out.append((k, at // 4, len(own) // 4, zlib.crc32(own), own))
                cols = list(zip(*out)) or [[]] * 5
                keys = part.select([0, 1]).take(pa.array(source, pa.int64()))
                arrays = [*keys.columns, pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
                names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[4], pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


def _packed(items: DataFrame, capacity: int, per_group: int) -> DataFrame:
    """items (key, length) with bin and at, packed in groups of about per_group items."""
    groups = partitions_for(items.count(), per_group)
    kind = items.schema["key"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("length", "descending"), ("key", "ascending")])
        lengths = order.column("length").to_numpy()
        bins, at, fill = repaired(lengths, *sum_of_squares(lengths, capacity), capacity)
        names = (order.column("g")[0].as_py() << 32) + bins if len(bins) else bins
        return pa.table({"key": order.column("key"), "length": order.column("length"), "bin": pa.array(names, pa.int64()), "at": pa.array(at, pa.int64()), "fill": pa.array(fill[bins], pa.int64())})

    dealt = items.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, f"key {kind}, length long, bin long, at long, fill long")


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end: int = END, with_ids: bool = False) -> DataFrame:
    """Packs every document: pieces() and sequence_id, offset.

    Pieces of full length are sequences of their own. The others are dealt by hash into groups of about GROUP_PIECES,
    each packed longest first by sum_of_squares and then repaired; sequences left with a gap of OPEN_GAP or more are then packed once more
    as items, so that groups leave next to no sequence half empty. A group's size does not grow with the input.

    An empty table gives no rows; ties are broken by row and piece, so a rerun over the same files packs alike.
    """
    cut = written(pieces(docs, tokenizer, doc_id, text, capacity, end, with_ids), "pieces")
    key = F.struct("row", "piece").alias("key")
    first = written(_packed(cut.filter(F.col("length") < capacity).select(key, "length"), capacity, GROUP_PIECES), "packed")
    bins = first.filter(F.col("fill") <= capacity - OPEN_GAP).groupBy(F.col("bin").alias("key")).agg(F.max("fill").alias("length"))
    again = _packed(written(bins, "open"), capacity, GROUP_PIECES).select(F.col("key").alias("bin"), F.col("bin").alias("new"), F.col("at").alias("base"))
    merged = first.join(again, "bin", "left").select(
        F.col("key.row").alias("row"), F.col("key.piece").alias("piece"),
        F.coalesce(F.col("new") * 2 + 1, F.col("bin") * 2).alias("sequence_id"), (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset"))
    short = cut.filter(F.col("length") < capacity).join(merged, ["row", "piece"])
    full = cut.filter(F.col("length") >= capacity).withColumn("offset", F.lit(0).cast("long"))
    full = full.withColumn("sequence_id", -F.monotonically_increasing_id() - 1)  # over written rows: the same in each run of a task
    return full.select(*short.columns).unionByName(short)
