"""Scores of texts by a byte model that weights context trees."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, written
from .context_tree import DEPTH, END, PIECES, SEPARATOR, runs, shortened, weighted, windows

EIGHT = "array<double>"


@dataclass(frozen=True)
class Settings:
    """block: bytes of text that a task looks at together, whole texts but for pieces of piece words. parts: how many
    parts a block's contexts and words are dealt into. group_bits: the blocks of 2^group_bits tasks meet. rows: rows of
    the tree that are weighted at once, whole subtrees of two depths."""

    block: int = 12_000_000
    piece: int = 1 << 19
    parts: int = 128
    group_bits: int = 6
    rows: int = 100_000


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0, as differences where they ascend, byte by byte, compressed."""
    rising = len(values) > 1 and bool((values[1:] >= values[:-1]).all())
    x = np.diff(values, prepend=0) if rising else values
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    width = max(1, int((int(x.max(initial=0)).bit_length() + 7) // 8))
    return bytes([rising, width]) + zstandard.compress(planes[:width].tobytes(), 1)


def loosened(data: bytes) -> np.ndarray:
    width, flat = data[1], np.frombuffer(zstandard.decompress(data[2:]), dtype=np.uint8)
    planes = np.zeros((len(flat) // width, 8), dtype=np.uint8)
    planes[:, :width] = flat.reshape(width, -1).T
    x = planes.view("<u8").ravel().astype(np.int64)
    return np.cumsum(x) if data[0] else x


def pieces_of(text: bytes | None, most: int) -> list[tuple[bytes, int, bytes]]:
    """A text as pieces of at most `most` words: bytes, tokens, and the DEPTH bytes before. Every word is followed by the
    separator, the last piece by the end, which is a token."""
    words, out, before = (text or b"").lower().split(), [], bytes(DEPTH)
    for i in range(0, max(1, len(words)), most):
        part, last = words[i : i + most], i + most >= len(words)
        body = SEPARATOR.join(part) + (SEPARATOR if part else b"") + (END if last else b"")
        out.append((body, len(part) + last, before))
        before = (before + body)[-DEPTH:]
    return out


def words_of(pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, by part of parts they are dealt into first; and the number of each token's word, of its piece. The
    end is the empty word."""
    own: dict[bytes, int] = {b"": 0}
    codes, sizes = [], []
    for x in pieces:
        words = x.split()
        codes.append(np.fromiter((own.setdefault(w, len(own)) for w in words), dtype=np.int64, count=len(words)))
        if x.endswith(END):
            codes[-1] = np.r_[codes[-1], 0]
        sizes.append(len(codes[-1]))
    return list(own), np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64), np.repeat(np.arange(len(pieces)), sizes)


def dealt(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % parts for w in words), dtype=np.int64, count=len(words))


def key_parts(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key."""
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def score_texts(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row of docs.

    A-Z are lower-cased; tokens are the words between ASCII white space and one end. The model is over the bytes of the
    words, each with a separator after it, and the end, so its probabilities of all texts sum to 1. A byte is eight binary
    decisions; each is predicted by the mixture, over contexts of 0 to DEPTH bytes before it, of Krichevsky-Trofimov
    estimates with the weights of context trees, as learned from the rows for which learn holds. score is log10 of the
    text's probability, bits_per_byte its code length over the bytes. base_score is that of words counted plus one.

    Texts are put into blocks of bounded size, which are written. A block counts its distinct contexts, with the byte
    after each, and its distinct words, and deals both into parts. Parts meet by groups of tasks, and what is distinct in
    these is summed over all documents. The tree is weighted from its greatest depth up, two depths at a time: contexts
    that agree in all but two bytes are in one task, no more than 2^24 rows whatever the corpus; the highest two depths
    are one small group. A context's prediction is joined back to the groups that have it, their parts give each block its
    predictions, and a block sums them by text. No text, and no table of the corpus, is on the driver.

    Null and empty text has the end only. A null learn counts as false; with nothing to learn from every decision is even.
    Rows that repeat a doc_id are scored, and learned from, each. An empty table gives no rows.
    """
    s, spark = settings, docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    kind = source.schema["doc_id"].dataType
    fields = lambda *x: T.StructType([T.StructField(c, t) for c, t in x])
    long, binary, of = T.LongType(), T.BinaryType(), T.ArrayType
    held = fields(("block", long), ("rows", of(long)), ("ids", of(kind)), ("learn", of(T.BooleanType())), ("tokens", of(long)), ("sizes", of(long)), ("befores", binary), ("texts", binary))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, row, size, held_rows = TaskContext.get().partitionId() << 32, 0, 0, 0, []

        def packed() -> pa.RecordBatch:
            rows, ids, learned, tokens, bodies, befores = zip(*held_rows)
            return pa.RecordBatch.from_pylist([{
                "block": task + number, "rows": rows, "ids": ids, "learn": learned, "tokens": tokens, "sizes": list(map(len, bodies)),
                "befores": b"".join(befores), "texts": zstandard.compress(b"".join(bodies), 1)}], schema=to_arrow_schema(held))

        for batch in batches:
            for one, data, learned in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                for body, tokens, before in pieces_of(data.as_py(), s.piece):
                    if held_rows and (size + len(body) > s.block or len(held_rows) == PIECES):
                        yield packed()
                        number, size, held_rows = number + 1, 0, []
                    held_rows.append((task + row, one, learned, tokens, body, before))
                    size += len(body)
                row += 1
        if held_rows:
            yield packed()

    def opened(row: dict) -> tuple[list[bytes], list[bytes]]:
        whole, ends = zstandard.decompress(row["texts"]), np.cumsum(row["sizes"]).tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends)], [row["befores"][i * DEPTH : (i + 1) * DEPTH] for i in range(len(ends))]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (x for b in batches for x in b.to_pylist()):
            pieces, befores = opened(row)
            learned = np.array(row["learn"], dtype=bool)
            found = windows(pieces, befores)
            keys = (found >> np.uint64(16)).astype(np.int64)
            first = runs(keys)
            n = np.add.reduceat(learned[found & np.uint64(PIECES - 1)].astype(np.int64), first) if len(first) else first
            keys = keys[first]
            del found
            words, code, piece = words_of(pieces)
            c = np.bincount(code[learned[piece]], minlength=len(words)).astype(np.int64)
            of_key, of_word = key_parts(keys, s.parts), dealt(words, s.parts)
            for part in range(s.parts):
                mine, own = of_key == part, np.flatnonzero(of_word == part).tolist()
                names = [words[i] for i in own]
                if mine.any() or names:
                    yield pa.RecordBatch.from_pylist([{
                        "block": row["block"], "part": part, "keys": squeezed(keys[mine]), "n": squeezed(n[mine]),
                        "words": zstandard.compress(b" ".join(names), 1), "c": squeezed(c[own]), "n_words": len(names)}], schema=to_arrow_schema(sent))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is distinct of each group and part, whose rows stand together: (group, key, n) or (group, word, n)."""
        group, keys, counts, words = None, [], [], {}

        def ended() -> Iterator[pa.RecordBatch]:
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), group)), pa.array(found), pa.nulls(len(found), pa.binary()), pa.array(sums)], names=["group", "key", "word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), group)), pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["group", "key", "word", "n"])

        for row in (x for b in batches for x in b.to_pylist()):
            if row["group"] != group:
                if group is not None:
                    yield from ended()
                group, keys, counts, words = row["group"], [], [], {}
            keys.append(loosened(row["keys"]))
            counts.append(loosened(row["n"]))
            for w, c in zip(names_of(row), loosened(row["c"]).tolist()):
                words[w] = words.get(w, 0) + c
        if group is not None:
            yield from ended()

    def names_of(row: dict) -> list[bytes]:
        return zstandard.decompress(row["words"]).split(SEPARATOR) if row["n_words"] else []

    def answered(parts: pa.Table, known: pa.Table) -> pa.Table:
        """For each row of parts, the predictions of its keys and the counts of its words, in its order."""
        is_key = np.asarray(known.column("key").is_valid())
        keys, p = known.column("key").to_numpy()[is_key].astype(np.int64), known.column("p").to_numpy()[is_key]
        order = np.argsort(keys)
        keys, p = keys[order], p[order]
        word = known.filter(pa.array(~is_key))
        c = dict(zip(word.column("word").to_pylist(), word.column("c").to_pylist()))
        out = []
        for row in parts.to_pylist():
            mine = p[np.searchsorted(keys, loosened(row["keys"]))]
            names = names_of(row)
            out.append({"block": row["block"], "part": row["part"], "p": zstandard.compress(mine.astype("<f4").tobytes(), 1), "c": squeezed(np.fromiter((c[w] for w in names), dtype=np.int64, count=len(names)))})
        return pa.Table.from_pylist(out, schema=to_arrow_schema(given))

    def summed(text: pa.Table, parts: pa.Table) -> pa.Table:
        out = []
        for row in text.to_pylist():
            pieces, befores = opened(row)
            n = len(pieces)
            found = windows(pieces, befores)
            keys = (found >> np.uint64(16)).astype(np.int64)
            first = runs(keys)
            many, keys = np.diff(np.r_[first, len(found)]), keys[first]
            words, code, piece = words_of(pieces)
            of_key, of_word = key_parts(keys, s.parts), dealt(words, s.parts)
            p, c = np.zeros(len(keys)), np.zeros(len(words), dtype=np.int64)
            for part, ps, cs in zip(*(parts.column(x).to_pylist() for x in ("part", "p", "c"))):
                p[of_key == part] = np.frombuffer(zstandard.decompress(ps), dtype="<f4")
                c[of_word == part] = loosened(cs)
            score = np.bincount((found & np.uint64(PIECES - 1)).astype(np.int64), np.repeat(p, many), n)
            base = np.bincount(piece, np.log10((c + 1) / (total + size + 1))[code], n)
            out.append(pa.table({
                "row": pa.array(row["rows"], pa.int64()), "doc_id": pa.array(row["ids"], to_arrow_schema(held).field("ids").type.value_type), "learned": pa.array(row["learn"], pa.bool_()), "n_tokens": pa.array(row["tokens"], pa.int64()),
                "n_known": pa.array(np.bincount(piece, (c > 0)[code], n).astype(np.int64)), "base_score": pa.array(base), "score": pa.array(score), "n_bytes": pa.array(row["sizes"], pa.int64())}))
        return pa.concat_tables(out)

    sent = fields(("block", long), ("part", T.IntegerType()), ("keys", binary), ("n", binary), ("words", binary), ("c", binary), ("n_words", long))
    given = fields(("block", long), ("part", T.IntegerType()), ("p", binary), ("c", binary))
    texts = written(source.mapInArrow(blocks, held), "texts")
    counts = written(texts.mapInArrow(counted, sent), "contexts").withColumn("group", F.shiftright("block", 32 + s.group_bits) * s.parts + F.col("part"))
    found = written(counts.repartition("group").sortWithinPartitions("group").mapInArrow(distinct, "group long, key long, word binary, n long"), "distinct")
    words = found.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c"))
    words = written(words, "words")
    total, size = (x or 0 for x in words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first())
    tree = predictions(found.filter("word IS NULL").groupBy("key").agg(F.sum("n").alias("n")), s)
    known = found.filter("word IS NULL").select("group", "key").join(tree, "key").select("group", "key", "p", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("c"))
    known = known.unionByName(found.filter("word IS NOT NULL").select("group", "word").join(words, "word").select("group", F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("p"), "word", "c"))
    answers = counts.groupBy("group").cogroup(known.groupBy("group")).applyInArrow(answered, given)
    shape = f"row long, doc_id {kind.simpleString()}, learned boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(summed, shape)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known")] + [F.lit(total).cast("long").alias("train_tokens")] + [F.sum(c).alias(c) for c in ("base_score", "score", "n_bytes")]
    return scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("learned").alias("learned"), *sums).drop("row").withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes"))


def predictions(rows: DataFrame, settings: Settings) -> DataFrame:
    """key, p of rows (key, n): log10 of the weighted probability of a byte in its context, key holding both."""
    tiers, up = [], rows.withColumn("below", F.lit(None).cast(EIGHT))
    for depth, top in ((5, 3), (3, 1), (1, -1)):
        group = F.shiftright(shortened(F.col("key"), top), 8) if top >= 0 else F.lit(0)
        near = up.withColumn("near", group)
        # two depths of one subtree hold 2^24 rows at most; the whole of depths 1 and 0 holds 2^16
        near = near.repartition("near").sortWithinPartitions("near") if top >= 0 else near.coalesce(1)
        both = written(near.mapInArrow(_tier(depth, depth - top, settings.rows), f"key long, n long, a {EIGHT}, b {EIGHT}, below {EIGHT}"), "tier")
        tiers.append(both.filter("a IS NOT NULL").select("key", "a", "b"))
        up = both.filter("below IS NOT NULL").select("key", "n", "below")
    top = tiers[-1]  # of depths 1 and 0
    for depth, tier in ((1, tiers[1]), (3, tiers[0])):
        over = top.select(F.col("key").alias("upper"), F.col("a").alias("a1"), F.col("b").alias("b1"))
        met = tier.withColumn("upper", shortened(F.col("key"), depth)).join(over, "upper")
        mix = lambda x, y: x + y
        top = met.select("key", F.zip_with("a1", F.zip_with("b1", "a", lambda x, y: x * y), mix).alias("a"), F.zip_with("b1", "b", lambda x, y: x * y).alias("b"))
    return top.select("key", F.aggregate("a", F.lit(0.0), lambda t, x: t + F.log10(x)).alias("p"))


def _tier(depth: int, levels: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Weights of some depths for partitions whose subtrees ("near") stand together: a row with a and b for each row read,
    one with below for each (context above, byte)."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in waiting) >= rows:
                whole = pa.concat_tables(waiting)
                near = whole.column("near").to_numpy()
                cut = int(np.searchsorted(near, near[-1]))  # the last subtree may go on
                if cut:
                    yield from done(whole.slice(0, cut))
                waiting = [whole.slice(cut)]
        if waiting:
            yield from done(pa.concat_tables(waiting))

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, n = t.column("key").to_numpy(), t.column("n").to_numpy()
        below = None if t.column("below").null_count else t.column("below").combine_chunks().flatten().to_numpy().reshape(-1, 8)
        a, b, above, sums, up = weighted(key, n, below, depth, levels)
        eight = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 8, pa.int32()), pa.array(x.ravel()))
        none = lambda k: pa.nulls(k, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), eight(a), eight(b), none(len(key))], names=["key", "n", "a", "b", "below"])
        yield pa.RecordBatch.from_arrays([pa.array(above), pa.array(sums), none(len(above)), none(len(above)), eight(up)], names=["key", "n", "a", "b", "below"])

    return ran
