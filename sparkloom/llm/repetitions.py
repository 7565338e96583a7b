"""Maximal runs of repeated words by partition refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words of texts that are refined together; a longer text is refined alone. Texts of LONG_WORDS are gathered apart, as
#: lengths go on to a quarter of the longest text of a batch.
BATCH_WORDS, LONG_WORDS = 1 << 20, 1 << 11
#: Up to this length all neighbours are looked at, later only those that have become neighbours.
SCANNED = 3


def _ordered(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples of whole numbers in ascending order."""
    x, y, z = (int(v.max(initial=0)).bit_length() for v in (a, b, c))
    if x + y + z > 63:
        at = np.lexsort((c, b, a))
        return a[at], b[at], c[at]
    packed = np.sort((a << (y + z)) | (b << z) | c)
    return packed >> (y + z), packed >> z & ((1 << y) - 1), packed & ((1 << z) - 1)


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    changed = np.zeros(max(0, len(sorted_columns[0]) - 1), dtype=bool)
    for x in sorted_columns:
        changed |= x[1:] != x[:-1]
    return np.flatnonzero(np.r_[True, changed]) if len(sorted_columns[0]) else np.zeros(0, dtype=np.int64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges [start, start + size), one range after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Partition:
    """Positions of several texts in classes of equal factors, a length at a time.

    Positions of a class stand together in `members`; `after` and `before` are its next and previous position, or -1.
    `small` holds the positions of the classes that the next length is refined by: of the parts into which a class fell,
    all but the largest. A text ends with a position of its own class, so a factor never goes beyond its text.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.text = np.repeat(np.arange(len(sizes)), sizes + 1)
        n = len(self.text)
        last = np.cumsum(sizes + 1) - 1
        word = np.full(n, int(codes.max(initial=0)) + 1, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[last] = False
        word[inside] = codes
        self.least = last - sizes  # of each text
        self.longest = sizes // 4  # period of a run that counts
        text, word, place = _ordered(self.text, word, np.arange(n))
        first = _starts(text, word)
        self.size, self.start = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        counts = np.diff(np.r_[first, n])
        self.classes = len(first)
        self.size[: len(first)], self.start[: len(first)] = counts, first
        self.members, self.at, self.cls = place, np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        self.at[place] = np.arange(n)
        self.cls[place] = np.repeat(np.arange(len(first)), counts)
        self.after, self.before, self.moved = np.full(n, -1), np.full(n, -1), np.zeros(n, dtype=bool)
        self._link(place, np.repeat(np.arange(len(first)), counts))
        whole = _starts(text[first])  # a text's classes stand together; each text's largest one is left out
        top = np.repeat(np.maximum.reduceat(counts, whole), np.diff(np.r_[whole, len(first)]))
        largest = np.flatnonzero(counts == top)
        keep = np.ones(len(first), dtype=bool)
        keep[largest[_starts(text[first][largest])]] = False
        self.small = place[np.repeat(keep, counts)]

    def _link(self, place: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Makes neighbours of consecutive places of a group."""
        same = group[1:] == group[:-1]
        left, right = place[:-1][same], place[1:][same]
        first = _starts(group)
        self.before[place[first]] = -1
        self.after[place[np.r_[first[1:] - 1, len(place) - 1]] if len(place) else first] = -1
        self.after[left], self.before[right] = right, left
        return left, right

    def refine(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the next length; returns the pairs of positions that have become neighbours."""
        none = np.zeros(0, dtype=np.int64)
        s = self.small
        text = self.text[s]
        s = s[(s > self.least[text]) & (self.longest[text] >= length)]
        by, p = self.cls[s], s - 1
        keep = self.size[self.cls[p]] > 1
        old, by, p = _ordered(self.cls[p[keep]], by[keep], p[keep])
        self.small = none
        if not len(p):
            return none, none
        first = _starts(old, by)
        count = np.diff(np.r_[first, len(p)])
        parent = _starts(old[first])  # among groups
        of_parent = np.repeat(np.arange(len(parent)), np.diff(np.r_[parent, len(first)]))
        taken = np.add.reduceat(count, parent)
        rest = self.size[old[first][parent]] - taken
        whole = (rest == 0) & (np.diff(np.r_[parent, len(first)]) == 1)  # all of a class is followed alike
        if whole.any():
            stay = ~whole[of_parent]
            pick = np.repeat(stay, count)
            old, by, p = old[pick], by[pick], p[pick]
            if not len(p):
                return none, none
            first = _starts(old, by)
            count = np.diff(np.r_[first, len(p)])
            parent = _starts(old[first])
            of_parent = np.repeat(np.arange(len(parent)), np.diff(np.r_[parent, len(first)]))
            taken, rest = taken[~whole], rest[~whole]
        of = old[first][parent]  # the classes that fall apart
        # those that stay are linked past those that go: chains of the latter
        _, _, q = _ordered(np.repeat(np.arange(len(parent)), taken), np.zeros(len(p), dtype=np.int64), p)
        joined = self.after[q[:-1]] == q[1:]
        head, tail = q[np.r_[True, ~joined]], q[np.r_[~joined, True]]
        left, right = self.before[head], self.after[tail]
        has_left, has_right = left >= 0, right >= 0
        self.after[left[has_left]], self.before[right[has_right]] = right[has_left], left[has_right]
        both = has_left & has_right
        pairs = [(left[both], right[both])]
        # what goes takes the end of its class's range
        slots = _spread(self.start[of] + rest, taken)
        self.moved[p] = True
        there = self.members[slots]
        stays = there[~self.moved[there]]
        out = self.at[p] < np.repeat(self.start[of] + rest, taken)
        gaps = self.at[p[out]]
        self.members[gaps], self.at[stays] = stays, gaps
        self.members[slots], self.at[p] = p, slots
        self.moved[p] = False
        pairs.append(self._link(p, np.repeat(np.arange(len(first)), count)))
        # names: the largest group keeps the old one where nothing stays
        most = np.maximum.reduceat(count, parent)
        largest = np.flatnonzero(count == most[of_parent])
        largest = largest[_starts(of_parent[largest])]
        names = np.full(len(first), -1)
        names[largest[rest == 0]] = of[rest == 0]
        new = names < 0
        names[new] = self.classes + np.arange(int(new.sum()))
        self.classes += int(new.sum())
        self.size[of] = rest
        self.size[names], self.start[names] = count, slots[first]
        self.cls[p] = np.repeat(names, count)
        # all parts but the largest
        use = np.ones(len(first), dtype=bool)
        use[largest[rest < most]] = False
        less = (rest > 0) & (rest < most)
        self.small = np.r_[p[np.repeat(use, count)], self.members[_spread(self.start[of[less]], rest[less])]]
        return np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])


def squares(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, Partition]:
    """period and position of every square with a primitive root and a period of at most a quarter of its text's words:
    a position whose next one of the same class is as far as the class's factors are long."""
    p = Partition(codes, sizes)
    due: dict[int, list[int]] = {}
    found: list[tuple[np.ndarray, np.ndarray]] = []
    length = 1

    def hold(left: np.ndarray, right: np.ndarray) -> None:
        gap = right - left
        keep = (gap > length) & (gap <= p.longest[p.text[left]])
        gap, left = gap[keep], left[keep]
        if len(gap) > 32:
            order = np.argsort(gap, kind="stable")
            gap, left = gap[order], left[order]
            first = _starts(gap)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(gap)]):
                due.setdefault(int(gap[a]), []).extend(left[a:b].tolist())
        else:
            for g, i in zip(gap.tolist(), left.tolist()):
                due.setdefault(g, []).append(i)

    def take(i: np.ndarray, gap: int) -> None:
        i = np.unique(i[p.after[i] == i + gap])  # neighbours that moved together are there again
        if len(i):
            found.append((np.full(len(i), gap), i))

    most = int(p.longest.max(initial=0))
    while length <= most:
        if length <= SCANNED:
            i = np.flatnonzero(p.after >= 0)
            take(i[p.longest[p.text[i]] >= length], length)
            if length == SCANNED:
                hold(i, p.after[i])
        elif length in due:
            take(np.array(due.pop(length), dtype=np.int64), length)
        length += 1
        new = p.refine(length)
        if length > SCANNED:
            length -= 1
            hold(*new)
            length += 1
            if not len(p.small):
                break
    for gap, i in due.items():  # nothing moves any more
        if gap >= length:
            take(np.array(i, dtype=np.int64), gap)
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), p
    return np.concatenate([g for g, _ in found]), np.concatenate([i for _, i in found]), p


def runs_of(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, length, period of the runs of max(6, 4 * period) words at least, by text, start and period."""
    period, place, p = squares(codes, sizes)
    order = np.lexsort((place, period))
    period, place = period[order], place[order]
    first = np.flatnonzero(np.r_[True, (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)]) if len(place) else place
    last = np.r_[first[1:] - 1, len(place) - 1] if len(place) else place
    start, period = place[first], period[first]
    length = place[last] + 2 * period - start
    keep = length >= np.maximum(6, 4 * period)
    start, length, period = start[keep], length[keep], period[keep]
    text = p.text[start]
    start = start - p.least[text]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, collapsed of every row.

    Words are cut at ASCII white space. A run is a stretch of words with smallest period q, of max(6, 4 * q) words at
    least, that no word beside it continues. Texts are refined in batches of bounded size: positions are in one class
    when the factors of a length that start there are equal; each length refines the last by the smaller parts only.
    Neighbours of a class that are as far apart as the length are squares, and consecutive squares of one period a run.
    A row is worked on by itself, so nothing is shuffled.

    start, length, period and exponent_milli (1000 * length / period, rounded down) are those of the run with the greatest
    length / period, then the smallest start, then the smallest period; null without a run. runs holds all, by start and
    period; runs_sha256 is of their lines `start,length,period`. collapsed holds the words, joined by a blank, without
    those that a run contains after its first period. Null and empty text has no words and no run. Rows that repeat a
    doc_id count each. An empty table gives no rows.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    long, string = T.LongType(), T.StringType()
    run = T.StructType([T.StructField(c, long) for c in ("start", "length", "period")])
    shape = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *(T.StructField(c, long) for c in ("n_runs", "start", "length", "period", "exponent_milli")), *(T.StructField(c, string) for c in ("runs_sha256", "collapsed_sha256")), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", string)])

    def found(ids: tuple, texts: tuple[list[bytes], ...]) -> pa.RecordBatch:
        own: dict[bytes, int] = {}
        long_enough = [k for k, w in enumerate(texts) if len(w) >= 6]
        sizes = np.array([len(texts[k]) for k in long_enough], dtype=np.int64)
        codes = np.fromiter((own.setdefault(w, len(own)) for k in long_enough for w in texts[k]), dtype=np.int64, count=int(sizes.sum()))
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for k, *one in zip(*(x.tolist() for x in runs_of(codes, sizes))):
            runs.setdefault(long_enough[k], []).append(tuple(one))
        rows = []
        for k, (one, words) in enumerate(zip(ids, texts)):
            mine = runs.get(k, [])
            if mine:
                dropped = np.zeros(len(words) + 1, dtype=np.int64)
                for a, n, q in mine:
                    dropped[a + q] += 1
                    dropped[a + n] -= 1
                kept = np.cumsum(dropped)[:-1] == 0
                words = [w for w, x in zip(words, kept.tolist()) if x]
                a, n, q = min(mine, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
                best = {"start": a, "length": n, "period": q, "exponent_milli": 1000 * n // q}
            else:
                best = {}
            lines, left = "".join(f"{a},{n},{q}\n" for a, n, q in mine), b" ".join(words)
            rows.append({"doc_id": one, "n_runs": len(mine), **best, "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(left).hexdigest(), "runs": [dict(zip(("start", "length", "period"), r)) for r in mine], "collapsed": left.decode()})
        return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(shape))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        size = {True: 0, False: 0}
        for batch in batches:
            for one, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (data.as_py() or b"").split()
                kind = len(words) >= LONG_WORDS
                if held[kind] and size[kind] + len(words) > BATCH_WORDS:
                    yield found(*zip(*held[kind]))
                    held[kind], size[kind] = [], 0
                held[kind].append((one, words))
                size[kind] += len(words) + 1
        for rows in held.values():
            if rows:
                yield found(*zip(*rows))

    return source.mapInArrow(each, shape)


def planted(doc_id: Column, text: Column) -> Column:
    """text, or for a tenth of the ids one whose words repeat from some place on, as the id's checksum says."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words).cast("long")
    a = g % n
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.array_repeat(F.slice(words, (a + 1).cast("int"), p), F.ceil((n - a) / p).cast("int"))
    tail = F.slice(F.flatten(block), F.lit(1), (n - a).cast("int"))
    rebuilt = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), rebuilt).otherwise(text)


#: DuckDB SQL for op13's rows. The checksum is taken digit by digit and bit by bit.
RUNS_SQL = r"""
WITH d AS (
  SELECT doc_id, text, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)::UBIGINT[]), lambda v, k: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))) AS inverse
  FROM documents
), h AS (
  SELECT doc_id, CAST(xor(inverse, 4294967295::UBIGINT) AS BIGINT) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0 FROM d
), g AS (SELECT *, h // 10 AS g, CAST(len(w0) AS BIGINT) AS n FROM h),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w0[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w0 END AS w FROM p
), u AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t),
m AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island, x.i
  FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), r AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM m GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.l >= r.s + r.l)
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(l AS DECIMAL(18, 0)) * 1000000000000 // q DESC, s, q) = 1
), lines AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS lines FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
  SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS left_over FROM u LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY u.doc_id
)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
  CAST(1000 * l // q AS BIGINT) AS exponent_milli, coalesce(lines, sha256('')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
FROM t LEFT JOIN best ON best.doc_id = t.doc_id LEFT JOIN lines ON lines.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id
"""
