"""Token counts from piece counts of distinct pre-tokens."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import pack, unpack
from .tokenizing import load

#: The pattern by which byte-level BPE tokenizers cut a text before their merges.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents, and characters, of one block at most: its frequencies travel together.
BLOCK_DOCS, BLOCK_CHARS = 20_000, 12_000_000
#: Parts that a block's pre-tokens are dealt into by hash.
PARTS = 128
#: 2^GROUP_BITS tasks' blocks meet; a pre-token is joined once for each such group.
GROUP_BITS = 6


def _numbered() -> defaultdict[str, int]:
    found: defaultdict[str, int] = defaultdict()
    found.default_factory = found.__len__
    return found


def frequencies(texts: list[str], pattern, special) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens, and triples (number of the pre-token, document, frequency) sorted by both.

    Between single blanks a text may be cut by itself, the blank going with what follows; so the pattern runs once per
    distinct chunk of the block. Texts with a special token, or with a blank beside other white space or at an end, are
    cut whole.
    """
    first, later, own = _numbered(), _numbered(), _numbered()
    numbers, docs, whole = [], [], []
    for i, text in enumerate(texts):
        if special and special.search(text):
            whole.append(i)
        elif text:
            head, *rest = text.split(" ")
            numbers.append(np.fromiter([-1 - first[head], *map(later.__getitem__, rest)], dtype=np.int64, count=1 + len(rest)))
            docs.append(i)
    odd = lambda c: not c or c[0].isspace() or c[-1].isspace()
    chunks = [*later, *first]
    flagged = np.array([odd(c) for c in chunks], dtype=bool)
    at = np.repeat(np.array(docs, dtype=np.int64), [len(x) for x in numbers])
    code = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
    code = np.where(code < 0, len(later) - 1 - code, code)
    uneven = np.unique(at[flagged[code]]) if len(code) else at
    if len(uneven):
        even = ~np.isin(at, uneven)
        at, code = at[even], code[even]
    n = max(1, len(texts))
    pairs, times = np.unique(code * n + at, return_counts=True)
    code, at = pairs // n, pairs % n
    lead = len(later)
    cut = [() if flagged[k] else [own[x] for x in pattern.findall(" " + c if k < lead else c)] for k, c in enumerate(chunks)]
    lengths = np.array([len(x) for x in cut], dtype=np.int64)
    flat, starts = np.fromiter((x for c in cut for x in c), dtype=np.int64), np.cumsum(lengths) - lengths
    many = lengths[code] if len(code) else code
    token = flat[np.arange(many.sum()) + np.repeat(starts[code] - (np.cumsum(many) - many), many)] if len(code) else code
    at, times = np.repeat(at, many), np.repeat(times, many)
    extra = [(own[x], i) for i in [*whole, *uneven.tolist()] for x in _cut_whole(texts[i], pattern, special)]
    if extra:
        more = np.array(extra, dtype=np.int64)
        token, at, times = np.r_[token, more[:, 0]], np.r_[at, more[:, 1]], np.r_[times, np.ones(len(more), dtype=np.int64)]
    keys, inverse = np.unique(token * n + at, return_inverse=True)
    sums = np.bincount(inverse, weights=times, minlength=len(keys)).astype(np.int64)
    return list(own), keys // n, keys % n, sums


def _cut_whole(text: str, pattern, special) -> list[str]:
    """Pre-tokens of a text; special tokens are cut out before all else."""
    if not (special and special.search(text)):
        return pattern.findall(text)
    return [x for k, part in enumerate(special.split(text)) for x in ([part] if k % 2 else pattern.findall(part))]


def _words(names: bytes, lengths: bytes) -> list[str]:
    ends, whole = np.cumsum(unpack(lengths)).tolist(), names.decode()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, chars = [], [], 0
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = x.as_py() or ""
            ids.append(i)
            texts.append(text)
            chars += len(text)
            if len(ids) >= BLOCK_DOCS or chars >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Texts are cut into pre-tokens in blocks of rows of bounded size. A block deals its distinct pre-tokens, with their
    frequencies by document, into PARTS parts by hash; a row is one part of one block. The blocks of 2^GROUP_BITS tasks
    meet by part, and each names its distinct pre-tokens. The distinct pre-tokens of all of these are one table: the
    tokenizer runs once for each, on that pre-token alone, and its count of pieces is joined back to the groups that have
    it, where frequencies times pieces are summed. Partial sums are added up by block. No ids of texts are made.

    Null and empty text count 0 tokens and 0 bytes. Rows that repeat a doc_id are counted each. A special token's string
    inside a text counts as the tokenizer has it by default: one. An empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        strings = [t.content for t in load(tokenizer).get_added_tokens_decoder().values()]
        special, pattern = re.compile(f"({'|'.join(map(re.escape, strings))})") if strings else None, regex.compile(PRE_TOKEN)
        for k, (ids, texts) in enumerate(_blocks(batches)):
            block = (TaskContext.get().partitionId() << 32) + k
            yield row(block, -1, {"ids": ids, "bytes": [len(t.encode()) for t in texts]})
            names, token, at, times = frequencies(texts, pattern, special)
            of = np.fromiter((zlib.crc32(x.encode()) % PARTS for x in names), dtype=np.int64, count=len(names))
            place = np.argsort(of[token], kind="stable") if len(token) else token
            edges = np.searchsorted(of[token][place], np.arange(PARTS + 1)) if len(token) else np.zeros(PARTS + 1, dtype=np.int64)
            for part in range(PARTS):
                own = place[edges[part] : edges[part + 1]]
                if len(own):
                    mine = token[own]
                    starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                    words = [names[i] for i in mine[starts].tolist()]
                    yield row(block, part, {
                        "names": "".join(words).encode(), "lengths": pack(np.fromiter(map(len, words), dtype=np.int64, count=len(words))),
                        "runs": pack(np.diff(np.r_[starts, len(own)])), "docs": pack(at[own]), "times": pack(times[own])})

    def row(block: int, part: int, held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"block": block, "part": part} | held], schema=shape)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key and pre-token, once for each key; all rows of a key are in one partition."""
        seen: dict[int, set[str]] = {}
        for batch in batches:
            for key, names, lengths in zip(*(batch.column(c).to_pylist() for c in ("key", "names", "lengths"))):
                if names is not None:
                    own = seen.setdefault(key, set())
                    new = [x for x in _words(names, lengths) if x not in own]
                    own.update(new)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(new), pa.int64()), pa.array(new, pa.string())], names=["key", "token"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(tokenizer)
        for batch in batches:
            for part in (batch.slice(i, 10_000) for i in range(0, batch.num_rows, 10_000)):
                found = tokens.encode_batch_fast(part.column("token").to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column("token"), pa.array(map(len, found), pa.int32())], names=["token", "pieces"])

    def add(parts: pa.Table, counts: pa.Table) -> pa.Table:
        known, out = dict(zip(counts.column("token").to_pylist(), counts.column("pieces").to_pylist())), []
        for block, part, ids, n_bytes, names, lengths, runs, at, times in zip(*(parts.column(c).to_pylist() for c in ("block", "part", "ids", "bytes", "names", "lengths", "runs", "docs", "times"))):
            if part < 0:
                out.append({"block": block, "ids": ids, "bytes": n_bytes})
                continue
            words = _words(names, lengths)
            pieces = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
            sums = np.bincount(unpack(at), weights=np.repeat(pieces, unpack(runs)) * unpack(times)).astype(np.int64)
            met = np.flatnonzero(sums)
            out.append({"block": block, "docs": pack(np.diff(met, prepend=0)), "sums": pack(sums[met])})
        return pa.Table.from_pylist(out, schema=sent)

    def total(table: pa.Table) -> pa.Table:
        of = table.filter(pa.compute.is_valid(table.column("ids")))
        ids, n_bytes = of.column("ids").combine_chunks().flatten(), of.column("bytes").combine_chunks().flatten()
        tokens = np.zeros(len(ids), dtype=np.int64)
        for at, sums in zip(table.column("docs").to_pylist(), table.column("sums").to_pylist()):
            if at:
                tokens[np.cumsum(unpack(at))] += unpack(sums)
        return pa.table({"doc_id": ids, "n_bytes": n_bytes, "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)})

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind, binary = source.schema["doc_id"].dataType, T.BinaryType()
    of_docs = [("block", T.LongType()), ("ids", T.ArrayType(kind)), ("bytes", T.ArrayType(T.LongType()))]
    dealt = T.StructType([T.StructField(*x) for x in [of_docs[0], ("part", T.IntegerType()), *of_docs[1:], *((c, binary) for c in ("names", "lengths", "runs", "docs", "times"))]])
    summed = T.StructType([T.StructField(*x) for x in [*of_docs, ("docs", binary), ("sums", binary)]])
    shape, sent = to_arrow_schema(dealt), to_arrow_schema(summed)
    # a block's own row, of part -1, goes anywhere; block >> 32 is the task that cut it. One shuffle serves both uses below
    group = F.shiftright("block", 32 + GROUP_BITS)
    key = F.when(F.col("part") < 0, -1 - F.col("block")).otherwise(group * PARTS + F.col("part"))
    freq = source.mapInArrow(cut, dealt).withColumn("key", key).repartition("key")
    names = freq.mapInArrow(named, "key long, token string")
    pieces = names.select("token").distinct().mapInArrow(counted, "token string, pieces int")
    counts = names.join(pieces, "token")
    sums = freq.groupBy("key").cogroup(counts.groupBy("key")).applyInArrow(add, summed)
    return sums.groupBy("block").applyInArrow(total, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
