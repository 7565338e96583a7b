"""Pairs of names that are few edits apart: sorted names are cut into blocks, and blocks that may hold such a pair meet."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import ensure_checkpoint

#: Most rows of a block, blocks that one is compared with at once, parts that blocks are dealt into to be compared by their
#: beginnings, and pairs that are handed on at a time.
BLOCK, RUN, PARTS, HANDED = 2048, 32, 16, 1 << 16
#: Names of a block with one beginning from which on it is asked whether any name can still be near.
MANY = 16
_PAIRS = "a string, b string, n double"


def edits(length: str) -> str:
    """SQL: the edits that a pair may have whose longer name has this length."""
    return f"greatest(2, {length} div 4)"


def _end(names: list[str], start: int) -> int:
    """Where a block ends that begins at a place of sorted names: where names differ soonest, so that what it has in common is long."""
    least, best = start + max(1, BLOCK // 8), (0, 0)
    for k in range(least, min(start + BLOCK, len(names) - 1) + 1):
        apart = -len(commonprefix([names[k - 1], names[k]])) if len(names[k - 1]) == len(names[k]) else 1
        best = max(best, (apart, k)) if best[1] else (apart, k)
    return best[1] or len(names)


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held = TaskContext.get().partitionId() << 32, []

    def cut(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """Blocks of the rows; what is left waits."""
        nonlocal at, held
        names, tables, start = rows["x"].to_pylist(), rows["table"].to_pylist(), 0
        while start < len(names) if last else len(names) - start > BLOCK:
            end = len(names) if len(names) - start <= BLOCK // 8 else _end(names, start)
            x = names[start:end]
            at += 1
            yield pa.RecordBatch.from_pydict({"id": [at], "low": pa.array([len(x[0])], pa.int32()), "high": pa.array([len(x[-1])], pa.int32()), "head": [commonprefix([min(x), max(x)])], "x": [x], "table": [tables[start:end]]})
            start = end
        held = rows.slice(start).combine_chunks().to_batches()

    for part in parts:
        held.append(part.select(["x", "table"]))
        if sum(p.num_rows for p in held) > 4 * BLOCK:
            yield from cut(pa.Table.from_batches(held), False)
    if held:
        yield from cut(pa.Table.from_batches(held), True)


def blocks(named: DataFrame) -> DataFrame:
    """id, low, high (lengths), head (what all names begin with), x, table (arrays, sorted by length and name) of at most BLOCK rows."""
    order = [F.length("x"), "x", "table"]
    n = named.count() // (16 * BLOCK) + 1
    ranged = named.select("x", "table").repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(_cut, "id long, low int, high int, head string, x array<string>, table array<string>")


def meetings(cut: DataFrame) -> DataFrame:
    """a, b: blocks, a <= b, whose lengths and beginnings leave room for a pair. Two names have the edits at least that the
    cheapest way from one's beginning to some beginning of the other has."""
    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = cut.select("id", "low", "high", "head")
    left = heads.select(*[F.col(c).alias(f"a_{c}") for c in heads.columns], F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part"))
    right = heads.select(*[F.col(c).alias(f"b_{c}") for c in heads.columns], F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    most = edits("greatest(a_high, b_high)")
    ways = [f"array_min(transform(sequence(0, length({y})), i -> levenshtein({x}, substring({y}, 1, i))))" for x, y in (("a_head", "b_head"), ("b_head", "a_head"))]
    room = f"a_id <= b_id AND b_low - a_high <= {most} AND a_low - b_high <= {most} AND least({', '.join(ways)}) <= {most}"
    return left.repartition(n, "part").join(right.repartition(n, "part").hint("merge"), "part").filter(room).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


class Near:
    """Names that are compared with others at once, a bit for each of their letters (Myers); in Python's numbers beyond 64."""

    def __init__(self, names: list[str], whole: np.ndarray):
        """whole: the names' lengths, with a beginning that was cut off here and is cut off of the others."""
        self.length = np.array([len(x) for x in names], np.int32)
        self.whole = whole
        most = max(1, int(self.length.max()))
        self.kind = next((np.dtype(f"u{k}") for k in (2, 4, 8) if most <= 8 * k), np.dtype(object))
        self.bits = np.array([1 << i for i in range(most)], self.kind)
        self.letters = np.array(names, f"U{most}").view(np.uint32).reshape(len(names), most)
        self.mask = np.array([(1 << len(x)) - 1 for x in names], self.kind)
        self.masks: dict[str, np.ndarray] = {}
        self.count = np.frompyfunc(int.bit_count, 1, 1) if self.kind == object else np.bitwise_count
        self.one = 1 if self.kind == object else self.kind.type(1)

    def places(self, letter: str) -> np.ndarray:
        """The places of a letter in each name."""
        if (found := self.masks.get(letter)) is None:
            found = self.masks[letter] = ((self.letters == ord(letter)) * self.bits).sum(axis=1, dtype=self.kind)
        return found

    def begin(self) -> tuple:
        ones = np.array([(1 << len(self.bits)) - 1] * len(self.mask), self.kind)
        return None, ones, np.zeros(len(self.mask), self.kind)

    def step(self, state: tuple, letter: str) -> tuple:
        """State after a further letter: which names are left (None: all), and where edits rise and fall along each."""
        left, up, down = state
        eq = self.places(letter) if left is None else self.places(letter)[left]
        d = eq & up
        d += up
        d ^= up
        d |= eq
        d |= down
        hn = up & d
        hp = up | d
        np.invert(hp, out=hp)
        hp |= down
        hp += hp  # shifts are slower
        hp |= self.one
        down = hp & d
        hn += hn
        hp |= d
        np.invert(hp, out=hp)
        hp |= hn
        return left, hp, down

    def allowed(self, length: int) -> np.ndarray:
        return np.maximum(2, np.maximum(self.whole, length) // 4)

    def edits(self, state: tuple, length: int) -> np.ndarray:
        left, up, down = state
        mask = self.mask if left is None else self.mask[left]
        return self.count(up & mask).astype(np.int32) - self.count(down & mask).astype(np.int32) + length

    def prune(self, state: tuple, depth: int, low: int, high: int, allowed: np.ndarray) -> tuple:
        """State without names that no other of these lengths (less what was cut off) can be near to, after `depth` letters."""
        left, up, down = state
        length, mask = (self.length, self.mask) if left is None else (self.length[left], self.mask[left])
        up, down = up & mask, down & mask
        at = np.full(len(length), depth, np.int32)
        rest = length.copy()
        best = at + np.maximum(0, np.maximum(rest - (high - depth), (low - depth) - rest))
        for i in range(int(length.max(initial=0))):
            at += ((up >> i) & self.one).astype(np.int32)
            at -= ((down >> i) & self.one).astype(np.int32)
            rest -= 1
            # beyond a name's end its last value is met again, for lengths that are further off
            np.minimum(best, at + np.maximum(0, np.maximum(rest - (high - depth), (low - depth) - rest)), out=best)
        near = np.flatnonzero(best <= (allowed if left is None else allowed[left]))
        if len(near) * 2 > len(length):
            return state
        return (near if left is None else left[near]), state[1][near], state[2][near]


def near(x: list[str], y: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For sorted names y: an index, and those of x within the edits that the longer name allows, with their edits.

    What names of y begin with in common is compared once."""
    off = len(commonprefix([min(x), max(x), y[0], y[-1]]))
    own = Near([n[off:] for n in x], np.array([len(n) for n in x], np.int32))
    low, high = min(map(len, y)), max(map(len, y))
    most, allowed = own.allowed(high), {n: own.allowed(n) for n in {len(n) for n in y}}
    states, before, k = [own.begin()], y[0][:off], 0
    while k < len(y):
        name, gone = y[k], 0
        depth = len(commonprefix([before, name]))
        del states[depth - off + 1 :]
        for at in range(off + len(states), len(name) + 1):
            state = own.step(states[-1], name[at - 1])
            if k + MANY < len(y) and y[k + MANY].startswith(name[:at]):
                state = own.prune(state, at - off, low - off, high - off, most)
            states.append(state)
            if state[0] is not None and not len(state[0]):
                gone = at
                break
        if gone:  # no other name that begins so is near any
            before = name[:gone]
            k = bisect_right(y, before, k, key=lambda n: n[:gone])
            continue
        before, left = name, states[-1][0]
        found = own.edits(states[-1], len(name) - off)
        hit = np.flatnonzero(found <= (allowed[len(name)] if left is None else allowed[len(name)][left]))
        if len(hit):
            yield k, (hit if left is None else left[hit]), found[hit]
        k += 1


def _runs(x: list[str]) -> tuple[list[str], np.ndarray]:
    """The names without repeats that follow each other, and the row where each begins, with the end."""
    starts = [k for k in range(len(x)) if not k or x[k] != x[k - 1]]
    return [x[k] for k in starts], np.array([*starts, len(x)])


def _pairs(x: list[str], y: list[str], own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x and of y that make a pair, with their likeness; own: of one block, each pair once."""
    (x, fx), (y, fy) = _runs(x), _runs(y)
    order = sorted(range(len(y)), key=y.__getitem__)
    whole = np.array([len(n) for n in x])
    for k, hit, edit in near(x, [y[k] for k in order]):
        k, name = order[k], y[order[k]]
        if own:
            keep = hit <= k
            hit, edit = hit[keep], edit[keep]
        if len(name) >= 4:  # a name that holds the other has as many edits as it is longer, and another likeness
            for i in np.flatnonzero((edit > 0) & (edit == abs(whole[hit] - len(name))) & (whole[hit] >= 4)):
                if x[hit[i]] in name or name in x[hit[i]]:
                    edit[i] = -1
            hit, edit = hit[edit >= 0], edit[edit >= 0]
        counts = fx[hit + 1] - fx[hit]
        ends = np.cumsum(counts)
        a = np.repeat(fx[hit] - (ends - counts), counts) + np.arange(counts.sum())
        n = np.repeat(np.where(edit == 0, 1.0, np.where(edit <= 2, 0.55, 0.35)), counts)
        for b in range(fy[k], fy[k + 1]):
            some = a < b if own else slice(None)
            yield a[some], np.full(len(a[some]), b), n[some]


def _compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a block's rows with those of others, and among themselves where the block is one of them."""
    rows = sorted((r for p in parts for r in p.select(["id", "b", "own", "x", "table"]).to_pylist()), key=lambda r: r["id"])
    block = next(r for r in rows if r["id"] == r["b"])
    others = [r for r in rows if r["id"] != r["b"]]
    mine = pa.array(block["table"])
    for x, tables, own in (([n for r in others for n in r["x"]], pa.array([t for r in others for t in r["table"]], pa.string()), False), (block["x"], mine, True)):
        pending, size = [], 0
        for found in _pairs(x, block["x"], own) if x and (block["own"] or not own) else ():
            pending.append(found)
            size += len(found[0])
            if size >= HANDED:
                yield _handed(pending, tables, mine)
                pending, size = [], 0
        if size:
            yield _handed(pending, tables, mine)


def _handed(found: list[tuple], tables: pa.Array, mine: pa.Array) -> pa.RecordBatch:
    a, b, n = map(np.concatenate, zip(*found))
    return pa.RecordBatch.from_arrays([tables.take(pa.array(a)), mine.take(pa.array(b)), pa.array(n)], ["a", "b", "n"])


def near_names(named: DataFrame) -> DataFrame:
    """a, b, n: every pair of rows, a < b, of names x that are equal (1) or few edits apart (.55, .35) and don't hold each other
    with four letters or more. Needs: table, x (not empty).

    Equal names are rows of their own, so that many of them make many blocks, not a large one."""
    ensure_checkpoint(named.sparkSession)
    cut = blocks(named).checkpoint()
    n = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = meetings(cut).withColumn("run", F.floor((F.row_number().over(Window.partitionBy("b").orderBy("a")) - 1) / RUN))
    # a run's blocks, and the one that they meet
    own = runs.groupBy("b", "run").agg(F.max(F.col("a") == F.col("b")).alias("own")).select("b", "run", F.col("b").alias("id"), "own")
    both = runs.filter("a < b").select("b", "run", F.col("a").alias("id"), F.lit(False).alias("own")).unionByName(own)
    met = both.repartition(n, "id").join(cut.select("id", "x", "table").hint("merge"), "id")
    found = met.repartition(n, "b", "run").groupBy("b", "run").applyInArrow(_compare, _PAIRS)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n")
