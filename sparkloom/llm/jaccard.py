"""N-gram Jaccard self-join by vertical partitioning, and the groups that its links form."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, in_filter, member_filter, pack, unpack, written
from .components import connected

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_CACHE = 100_000
#: Sets, and n-grams of sets, that are sent as one part.
PART_SETS, PART_GRAMS = 2_000, 1_000_000
#: N-grams of a fragment of the order.
FRAGMENT_GRAMS = 4_000_000
#: Sets of a long list that are compared with each other in one cell.
BLOCK_SETS = 1_000
#: The order is cut into 2^PAIR_BITS fragments where overlaps of pairs are counted.
PAIR_BITS = 3


@dataclass(frozen=True)
class Rule:
    """Two sets link when 100 * intersection >= percent * union; a set is a text's distinct n-grams of words."""

    n: int = 4
    percent: int = 85


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of words between ASCII white space; those met before are kept."""

    def __init__(self, lower: bool):
        self.lower, self.known = lower, {}

    def of(self, text: str | None) -> np.ndarray:
        import xxhash

        data = (text or "").encode("utf-8", "surrogatepass")
        words = (data.lower() if self.lower else data).split()  # bytes: A-Z and ASCII white space only
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            new = set(words).difference(known)
            if len(known) + len(new) > _CACHE:
                known = self.known = {}
                new = set(words)
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for j in range(n):
        out += words[j : j + count] * (_ODD[j % len(_ODD)] + np.uint64(2 * (j // len(_ODD))))
    return mix(out)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted set of a text's n-gram hashes; a shorter text is one n-gram as a whole, without words none."""
    if len(words) == 0:
        return words
    if len(words) < n:
        return mix(np.array([(words * _ODD[: len(words)]).sum() + np.uint64(len(words))], dtype=np.uint64))
    return np.unique(rolling(words, n))


def _key(found: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    import xxhash

    whole = xxhash.xxh3_128_intdigest(found.tobytes())
    return tuple(int(x) - (1 << 64 if x >> 63 else 0) for x in (whole >> 64, whole & (1 << 64) - 1))


def _sets(batches: Iterator[pa.RecordBatch], text: str, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of batches, of bounded size, and their texts' sets."""
    words = Words(lower=True)
    for batch in batches:
        first, found, total = 0, [], 0
        for i, x in enumerate(batch.column(text)):
            found.append(grams(words.of(x.as_py()), n))
            total += len(found[-1])
            if len(found) == PART_SETS or total >= PART_GRAMS or i == batch.num_rows - 1:
                yield batch.slice(first, len(found)), found
                first, found, total = i + 1, [], 0


def _by_fragment(flat: np.ndarray, owner: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of 2^bits fragments of the order that holds something: its number, its n-grams set by set, and each set's number and count."""
    fragment = (flat >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)  # short ones are sorted by radix
    order = np.argsort(fragment, kind="stable")
    edges = np.flatnonzero(np.r_[True, fragment[order][1:] != fragment[order][:-1], True]) if len(flat) else []
    for a, b in zip(edges[:-1], edges[1:]):
        own = owner[order[a:b]]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        yield int(fragment[order[a]]), flat[order[a:b]], own[starts], np.diff(np.r_[starts, len(own)])


def _shared(table: pa.Table) -> pa.Table:
    """Of one fragment: per part of sets, how many n-grams of each of its sets are in a different set too.

    Sets are told apart by the 64 bits of their first key. What came twice is one set that several tasks sent.
    """
    owners = [np.frombuffer(x, dtype="<i8") for x in table.column("owners").to_pylist()]
    owner, count = np.concatenate(owners), np.concatenate(list(map(unpack, table.column("counts").to_pylist())))
    flat = np.concatenate([np.frombuffer(x, dtype="<u4") for x in table.column("grams").to_pylist()])
    starts = np.cumsum(count) - count
    _, once = np.unique(owner, return_index=True)
    kept = np.zeros(len(owner), dtype=bool)
    kept[once] = True
    found, times = np.unique(flat[np.repeat(kept, count)], return_counts=True)
    common = np.r_[found[times > 1], np.uint32(0)]  # one more, so that each search ends within
    common = common[np.minimum(np.searchsorted(common[:-1], flat), len(common) - 1)] == flat if len(common) > 1 else np.zeros(len(flat), dtype=bool)
    sums, edges = np.add.reduceat(common.astype(np.int64), starts), np.cumsum([0, *map(len, owners)])
    some = [np.flatnonzero(sums[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({"part": table.column("part"), "owners": pa.array([o[k].tobytes() for o, k in zip(owners, some)], pa.binary()),
                     "sums": pa.array([pack(sums[a:b][k]) for a, b, k in zip(edges[:-1], edges[1:], some)], pa.binary()), "keys": pa.nulls(len(owners), pa.binary())})


def _alive(percent: int):
    """Rows of one part of sets to the keys of those that share enough of their n-grams to link with anything."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("owners", "sums", "keys"))))
        key, size = next((np.frombuffer(keys, dtype="<i8"), unpack(sums)) for _, sums, keys in rows if keys is not None)
        names, where = np.unique(key, return_inverse=True)
        total = np.zeros(len(names), dtype=np.int64)
        for owners, sums, keys in rows:
            if keys is None and owners:
                total[np.searchsorted(names, np.frombuffer(owners, dtype="<i8"))] += unpack(sums)
        return pa.table({"k1": pa.array(key[100 * total[where] >= percent * size])})

    return run


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parities of how many n-grams of a set fall on each of its bits, four or more for each n-gram, as 64-bit words.

    Sets differ in at least as many n-grams as their bitmaps differ in bits.
    """
    size = 64
    while size < 4 * len(found):
        size *= 2
    odd = np.bincount((mix(found + _ODD[4]) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (the last axis) of the same sets with fewer bits."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_link(differ, a, b, percent: int):
    """Whether sets of sizes a and b that differ in `differ` n-grams or more may link."""
    both = (a + b - differ) // 2
    return 100 * both >= percent * (a + b - both)


def _across(ids: np.ndarray, size: np.ndarray, component: np.ndarray, side: np.ndarray, bits: list[bytes], percent: int) -> list[np.ndarray]:
    """Pairs of sets of different components, and of different sides where there are two, whose bitmaps let them link."""
    length, out = np.array([len(x) // 8 for x in bits]), []
    of = {w: np.flatnonzero(length == w) for w in np.unique(length).tolist()}
    rows = {(w, w): np.stack([np.frombuffer(bits[i], dtype="<u8") for i in at.tolist()]) for w, at in of.items()}
    rows |= {(w, w // 2): folded(x, w // 2) for (w, _), x in list(rows.items()) if w // 2 in of}
    place = {i: k for at in of.values() for k, i in enumerate(at.tolist())}
    values, times = np.unique(component, return_counts=True)
    most = values[times.argmax()]  # its sets are only met from the other end
    for i in np.flatnonzero(component != most).tolist():
        own = int(length[i])
        for w in (own // 2, own, own * 2):  # the sizes of sets that link differ by less than that
            if w not in of:
                continue
            other, least = of[w], min(own, w)
            far = (component[other] != component[i]) & ((component[other] == most) | (other > i)) & ((side[other] != side[i]) | (side[i] < 0))
            far &= 100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])
            if far.any():
                differ = np.bitwise_count(rows[w, least][far] ^ rows[own, least][place[i]]).sum(axis=1, dtype=np.int64)
                met = other[far][may_link(differ, size[other[far]], size[i], percent)]
                out.append(np.stack([np.full(len(met), ids[i]), ids[met]], axis=1))
    return out


def _crossing(percent: int):
    """Rows sorted by (gram, x, y) to candidate pairs; groups of those are of bounded size and held one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            yield from found(rest, False)
            rest = last(rest)
        if rest is not None and rest.num_rows:
            yield from found(rest, True)

    def edges(table: pa.Table) -> np.ndarray:
        keys = np.stack([table.column(c).to_numpy() for c in ("gram", "x", "y")])
        return np.flatnonzero(np.r_[True, (np.diff(keys) != 0).any(axis=0), True])

    def last(table: pa.Table) -> pa.Table:
        return table.slice(edges(table)[-2]) if table.num_rows else table

    def found(table: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        at = edges(table)
        ids, size, component, side = (table.column(c).to_numpy() for c in ("id", "n", "component", "side"))
        bits, out = table.column("bits"), []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if whole or b < table.num_rows:
                out += _across(ids[a:b], size[a:b], component[a:b], side[a:b], bits.slice(a, b - a).to_pylist(), percent)
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.zeros((0, 2), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _near(percent: int):
    """Pairs with sizes and bitmaps (na, nb, xa, xb) to those that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, xa, xb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))):
                xa, xb = np.frombuffer(xa, dtype="<u8"), np.frombuffer(xb, dtype="<u8")
                words = min(len(xa), len(xb))
                keep.append(bool(may_link(int(np.bitwise_count(folded(xa, words) ^ folded(xb, words)).sum()), na, nb, percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """Of one fragment: per part of sets, their n-grams that several sets hold, with the number of those sets."""
    flat = [np.frombuffer(x, dtype="<u8") for x in table.column("grams").to_pylist()]
    _, where, times = np.unique(np.concatenate(flat), return_inverse=True, return_counts=True)
    out, at = {"owners": [], "grams": [], "times": []}, 0
    for own, mine in zip(table.column("owners").to_pylist(), flat):
        often = times[where[at : at + len(mine)]]
        at += len(mine)
        keep = often > 1
        out["owners"].append(pack(unpack(own)[keep]))
        out["grams"].append(mine[keep].tobytes())
        out["times"].append(pack(often[keep]))
    return pa.table({"part": table.column("part"), **{c: pa.array(x, pa.binary()) for c, x in out.items()}, "ids": pa.nulls(len(flat), pa.binary()), "sizes": pa.nulls(len(flat), pa.binary())})


def _rarest(percent: int):
    """Rows of one part of sets to the rarest n-grams of each: gram, id, n, score."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("owners", "grams", "times", "ids", "sizes"))))
        ids, size = next((np.frombuffer(i, dtype="<i8"), unpack(n)) for *_, i, n in rows if i is not None)
        own, gram, times = (np.concatenate([np.zeros(0, dtype=d), *(f(r[k]) for r in rows if r[3] is None)]) for k, d, f in
                            ((0, np.int64, unpack), (1, np.uint64, lambda x: np.frombuffer(x, dtype="<u8")), (2, np.int64, unpack)))
        order = np.lexsort((gram, times, own))
        own, gram = own[order], gram[order]
        shared = np.bincount(own, minlength=len(ids))
        place = np.arange(len(own)) - (np.cumsum(shared) - shared)[own]
        # n - ceil(percent * n / 100) + 1 n-grams; those that no other set holds come first and are left out
        keep = place < (shared + 1 + -percent * size // 100)[own]
        own = own[keep]
        return pa.table({"gram": pa.array(gram[keep].view(np.int64)), "id": pa.array(ids[own]), "n": pa.array(size[own]), "score": pa.array((shared / size)[own])})

    return run


def _linked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b) that link: partial overlaps are counted in each fragment and summed per pair."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "pair-ids")
    held = written(sets.select("id", "n", "grams").join(ids, "id", "left_semi").mapInArrow(_fragments, "id long, n long, fragment int, grams array<long>"), "pair-sets")
    left = held.select(F.col("id").alias("a"), "fragment", F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = held.select(F.col("id").alias("b"), "fragment", F.col("n").alias("nb"), F.col("grams").alias("gb"))
    parts = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    total = parts.groupBy("a", "b").agg(F.sum("part").alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return total.filter(100 * F.col("both") >= rule.percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of some sets and the number of each one's set."""
    return lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sets (id, n, grams) to a row for each of the fragments where overlaps of pairs are counted."""
    for batch in batches:
        for f, held, own, count in _by_fragment(*_flat(batch.column("grams")), PAIR_BITS):
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(held.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), batch.column("n").take(pa.array(own)), pa.array(np.full(len(own), f, dtype=np.int32)), lists], names=["id", "n", "fragment", "grams"])


def _cut(bits: int):
    """Rows of sets' n-grams to rows (part, fragment) of 2^bits fragments; each part's row of fragment -1 names its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shape = pa.schema([("part", pa.int64()), ("fragment", pa.int32()), *((c, pa.binary()) for c in ("ids", "sizes", "owners", "grams"))])
        parts = (batch.slice(i, PART_SETS) for batch in batches for i in range(0, batch.num_rows, PART_SETS))
        for number, part in enumerate(parts):
            name, lists = (TaskContext.get().partitionId() << 32) + number, part.column("grams")
            out = [{"part": name, "fragment": -1, "ids": part.column("id").to_numpy().tobytes(), "sizes": pack(part.column("n").to_numpy())}]
            for f, held, own, count in _by_fragment(*_flat(lists), bits):
                out.append({"part": name, "fragment": f, "owners": pack(np.repeat(own, count)), "grams": held.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return run


def _lists(sets: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """gram, id, n, score: the rarest n-grams of each set, as many as two sets that link have one of in common.

    The order is by the number of sets that hold an n-gram, then by its hash. score is the part of a set that others hold.
    """
    cut = written(sets.select("id", "n", "grams").mapInArrow(_cut(bits), "part long, fragment int, ids binary, sizes binary, owners binary, grams binary"), "orders")
    counted = cut.filter("fragment >= 0").select("part", "fragment", "owners", "grams").groupBy("fragment").applyInArrow(_frequencies, "part long, owners binary, grams binary, times binary, ids binary, sizes binary")
    none = F.lit(None).cast("binary")
    base = cut.filter("fragment < 0").select("part", none.alias("owners"), none.alias("grams"), none.alias("times"), "ids", "sizes")
    return counted.unionByName(base).groupBy("part").applyInArrow(_rarest(rule.percent), "gram long, id long, n long, score double")


def _below_leaders(links: DataFrame) -> DataFrame:
    """node, component: sets of one component that the links (a leader, b) show within a few steps. Leaders share more than
    those they lead, or as much and have a larger id, so following them ends."""
    up = written(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), "leaders")
    for _ in range(2):
        far = up.select(F.col("node").alias("component"), F.col("component").alias("further"))
        up = written(up.join(far, "component", "left").select("node", F.coalesce("further", "component").alias("component")), "leaders")
    return up


def _dealt(lists: DataFrame, components: DataFrame) -> DataFrame:
    """Lists that hold several components, dealt into cells (gram, x, y) of bounded size in which pairs are compared.

    A long list's largest component is cut into blocks, and the other sets go to each of them; these are also compared
    with each other, in pairs of blocks. So rows are only repeated where a long list holds many sets that are not linked.
    """
    own = written(lists.join(components, F.col("id") == F.col("node"), "left").select("gram", "id", "n", F.coalesce("component", "id").alias("component")), "lists-components")
    by = own.groupBy("gram", "component").agg(F.count("*").alias("k"))
    facts = by.groupBy("gram").agg(F.max(F.struct("k", "component")).alias("most"), F.sum("k").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    facts = written(facts.select("gram", "all", F.col("most.k").alias("major"), F.col("most.component").alias("largest")), "lists-facts")
    rows = own.join(facts, "gram")
    block = lambda n: F.pmod(F.xxhash64("id"), n)
    blocks = lambda n: F.ceil(n / BLOCK_SETS)
    large, small = blocks(F.col("major")), blocks(F.col("all") - F.col("major"))
    cell = lambda x, y, side: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), side.cast("long").alias("side"))
    none = F.lit(-1)
    each = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
    cells = (F.when(F.col("all") <= 2 * BLOCK_SETS, F.array(cell(none, none, none)))
             .when(F.col("component") == F.col("largest"), F.array(cell(F.lit(-2), block(large), F.lit(0))))
             .otherwise(F.concat(each(large, lambda i: cell(F.lit(-2), i, F.lit(1))),
                                 each(small, lambda j: cell(F.least(block(small), j), F.greatest(block(small), j), F.when(block(small) == j, none).otherwise(block(small)))))))
    return rows.select("gram", "id", "n", "component", F.explode(cells).alias("cell")).select("gram", "id", "n", "component", "cell.x", "cell.y", "cell.side")


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id reachable over links, its own included).

    Vertical partitioning: the global order of n-grams is cut into fragments, and each set sends its n-grams to them.
    1. Equal sets are one class. In each fragment it is counted how many of a set's n-grams other sets hold too; these
       partial counts are summed per set. A set that shares less than rule.percent of its n-grams links with nothing.
    2. Of the other sets, the fragments count how many hold each n-gram; the rarest of a set lead to lists, and two sets
       that link share a list. Each set of a list is tried with the one that shares most, and links join components.
    3. Lists with several components are searched for further pairs. Sizes and parity bitmaps, which bound the overlap
       from above, leave few. All pairs left are verified: partial overlaps are counted in each fragment and summed.
    Sets that are in one component are not compared further, so a large group of near copies costs a row for each. The
    result loses no link and makes none: only hashes stand for words, of n-grams (64 bits) and of sets (128 bits; step 1 tells
    sets apart by 64 of these).

    Null, empty and wordless texts have no n-grams and link with nothing. Rows that repeat a doc_id are compared each, by
    their own texts. Rows without doc_id get no component. An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    total = source.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    # about one n-gram for every six bytes
    bits = math.ceil(math.log2(max(16, total / 6 / FRAGMENT_GRAMS)))
    whole, binary = T.LongType(), T.BinaryType()
    kinds = T.StructType([T.StructField(*x) for x in [
        ("doc_id", source.schema["doc_id"].dataType), *((c, whole) for c in ("n_shingles", "k1", "k2", "part")), ("fragment", T.IntegerType()), *((c, binary) for c in ("keys", "owners", "counts", "grams"))]])
    shape = to_arrow_schema(kinds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, sent = TaskContext.get().partitionId(), set()
        for number, (part, sets) in enumerate(_sets(batches, "text", rule.n)):
            both = [_key(x) if len(x) else (None, None) for x in sets]
            plain = {"doc_id": part.column(0), "n_shingles": pa.array(map(len, sets), pa.int64()), "k1": pa.array([k for k, _ in both], pa.int64()), "k2": pa.array([k for _, k in both], pa.int64())}
            yield pa.RecordBatch.from_arrays([plain[f.name] if f.name in plain else pa.nulls(len(sets), f.type) for f in shape], schema=shape)
            if len(sent) > _CACHE:
                sent = set()
            new = []
            for i, x in enumerate(sets):
                if len(x) and both[i] not in sent:  # a copy adds nothing
                    sent.add(both[i])
                    new.append(i)
            if new:
                key, name = np.array([both[i][0] for i in new], dtype="<i8"), (task << 32) + number
                size = np.array([len(sets[i]) for i in new])
                flat, owner = np.concatenate([sets[i] for i in new]), np.repeat(np.arange(len(new)), size)
                out = [{"part": name, "fragment": -1, "keys": key.tobytes(), "counts": pack(size)}]
                for f, held, own, count in _by_fragment(flat, owner, bits):
                    short = ((held << np.uint64(bits)) >> np.uint64(32)).astype("<u4")  # the fragment is known by its upper bits
                    out.append({"part": name, "fragment": f, "owners": key[own].tobytes(), "counts": pack(count), "grams": short.tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=shape)

    both = written(source.mapInArrow(cut, kinds), "sets")
    rows = written(both.filter("fragment IS NULL").select("doc_id", "n_shingles", "k1", "k2"), "keys")
    known = rows.filter(F.col("k1").isNotNull() & F.col("doc_id").isNotNull()).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    classes = written(known.withColumn("id", F.monotonically_increasing_id()), "classes")

    partial = both.filter("fragment >= 0").select("part", "fragment", "owners", "counts", "grams").groupBy("fragment").applyInArrow(_shared, "part long, owners binary, sums binary, keys binary")
    base = both.filter("fragment = -1").select("part", F.lit(None).cast("binary").alias("owners"), F.col("counts").alias("sums"), "keys")
    alive = partial.unionByName(base).groupBy("part").applyInArrow(_alive(rule.percent), "k1 long").distinct()
    classed = written(classes.join(alive, "k1", "left_semi").withColumn("h", F.xxhash64("rep")), "classes-alive")
    discard(both)
    wanted = member_filter(classed, "h")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=True)
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(wanted.value, batch.column("h").to_numpy().view(np.uint64))))
            keys = [_key(x) if len(x) else (0, 0) for x in (grams(words.of(x.as_py()), rule.n) for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("text"), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], names=["text", "k1", "k2"])

    # a filter of fixed size goes ahead, so few other texts are moved; any text of a class has its set
    texts = source.filter(F.col("doc_id").isNotNull()).withColumn("h", F.xxhash64("doc_id")).select("text", "h").mapInArrow(keyed, "text string, k1 long, k2 long")
    texts = texts.join(classed.select("k1", "k2", "id"), ["k1", "k2"]).groupBy("id").agg(F.min("text").alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, "text", rule.n):
            size = np.array([len(x) for x in sets], dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size), lists, pa.array([bitmap(x).tobytes() for x in sets], pa.binary())], names=["id", "n", "grams", "bits"])

    sets = written(texts.mapInArrow(packed, "id long, n long, grams array<long>, bits binary"), "sets-alive")
    bitmaps = sets.select("id", "n", "bits")
    lists = written(_lists(sets, rule, bits), "lists")

    lead = written(lists.groupBy("gram").agg(F.max(F.struct("score", "id", "n")).alias("lead"), F.count("*").alias("k")).filter("k > 1").select("gram", F.col("lead.id").alias("a"), F.col("lead.n").alias("na")), "leads")
    sizes = 100 * F.least("na", "n") >= rule.percent * F.greatest("na", "n")
    tried = lists.join(lead, "gram").filter((F.col("a") != F.col("id")) & sizes).select("a", F.col("id").alias("b")).distinct()
    with_bits = tried.join(bitmaps.toDF("a", "na", "xa"), "a").join(bitmaps.toDF("b", "nb", "xb"), "b")
    links = written(_linked(with_bits.mapInArrow(_near(rule.percent), "a long, b long"), sets, rule), "links")

    cells = _dealt(lists, _below_leaders(links)).join(bitmaps.select("id", "bits"), "id")
    across = cells.repartition("gram", "x", "y").sortWithinPartitions("gram", "x", "y").mapInArrow(_crossing(rule.percent), "a long, b long").distinct()
    more = written(_linked(across, sets, rule), "links")
    discard(sets)
    groups = connected(links.unionByName(more))

    of = written(classes.join(groups, F.col("id") == F.col("node")).select("id", "component", "rep"), "members")
    least = of.join(of.groupBy("component").agg(F.min("rep").alias("least")), "component").select("id", "least")
    named = classes.join(least, "id", "left").select("k1", "k2", F.coalesce("least", "rep").alias("component"))
    # copies may be a third of all rows: their class has one row on the other side, so adaptive execution splits them
    return rows.join(named, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


#: DuckDB SQL for op9's rows.
GROUPS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s : s + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS t(s) WHERE len(ws) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON r.root = e.a)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM reached r LEFT JOIN sizes s ON r.doc_id = s.doc_id GROUP BY r.doc_id
"""
