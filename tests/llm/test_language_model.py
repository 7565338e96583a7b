"""Scores of texts against a plain context tree, and on odd tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import context_tree, language_model


def learn():
    return F.crc32(F.col("doc_id").cast("string")) % 7 != 2



def brute(texts, learned):
    """(n_tokens, n_known, train_tokens, base_score, score) of every text, byte by byte."""
    depth = context_tree.DEPTH
    whole = [bytes(depth) + b"".join(w + b" " for w in (t or "").encode().lower().split()) + b"\n" for t in texts]
    counts, tokens = Counter(), Counter()
    for x, t, own in zip(whole, texts, learned):
        if own:
            tokens.update([*(t or "").encode().lower().split(), b""])
            for i in range(depth, len(x)):
                for j in range(8):
                    for d in range(depth + 1):
                        counts[x[i - d : i], j, x[i] >> (8 - j), x[i] >> (7 - j) & 1] += 1
    children = {}
    for context, j, prefix, _ in counts:
        if context:
            children.setdefault((context[1:], j, prefix), set()).add(context)
    known = {}

    def kt(context, j, prefix):
        a, b = counts[context, j, prefix, 0], counts[context, j, prefix, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(context, j, prefix):
        return sum(weighted(c, j, prefix) for c in children.get((context, j, prefix), ()))

    def weighted(context, j, prefix):
        if (context, j, prefix) not in known:
            own = kt(context, j, prefix)
            known[context, j, prefix] = own if len(context) == depth else math.log(0.5) + np.logaddexp(own, below(context, j, prefix))
        return known[context, j, prefix]

    def decision(x, i, j, d):
        context, prefix, bit = x[i - d : i], x[i] >> (8 - j), x[i] >> (7 - j) & 1
        a, b = counts[context, j, prefix, 0], counts[context, j, prefix, 1]
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == depth:
            return own
        share = math.exp(kt(context, j, prefix) + math.log(0.5) - weighted(context, j, prefix))
        return share * own + (1 - share) * decision(x, i, j, d + 1)

    n, v, out = sum(tokens.values()), len(tokens), []
    for x, t in zip(whole, texts):
        own = [*(t or "").encode().lower().split(), b""]
        out.append((len(own), sum(tokens[w] > 0 for w in own), n, sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in own),
                    sum(math.log10(decision(x, i, j, 0)) for i in range(depth, len(x)) for j in range(8))))
    return out


def scored(df, **k):
    return {r["doc_id"]: r for r in language_model.score_texts(df, learn(), **k).collect()}


@pytest.mark.parametrize("settings", [language_model.Settings(), language_model.Settings(block=300, piece=7, parts=3, group_bits=0, rows=50)])
def test_scores_match_a_plain_tree(spark, settings):
    texts = ["the cat sat on the mat", "The cat sat", None, "", " \t ", "a a a a a a a b", "naïve Élan 日本語 the", "x" * 40, "the end\nof the cat", "the cat sat on the mat", "b\x00c d"] * 2 + ["one two three " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    learned = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    assert 0 < sum(learned) < len(learned)
    found = scored(docs, settings=settings)
    for i, want in enumerate(brute(texts, learned)):
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["learned"]) == (*want[:3], learned[i])
        assert (r["base_score"], r["score"]) == pytest.approx(want[3:], rel=1e-5)


def test_probabilities_of_a_byte_sum_to_one(spark):
    rng = np.random.default_rng(4)
    key = np.unique(np.concatenate([(rng.integers(97, 100, 3000) << (8 * d)) for d in range(1)]) | rng.integers(97, 99, 3000) << 8 | rng.integers(97, 99, 3000) << 16)
    every = np.unique((key >> 8)[:, None] << 8 | np.arange(256))
    n = np.where(np.isin(every, key), 5, 0)
    a, *_ = context_tree.weighted(every, n, None, 2, 3)
    assert np.allclose(np.bincount(np.unique(every >> 8, return_inverse=True)[1], a.prod(axis=1)), 1)


def test_windows_keep_pieces_apart():
    found = context_tree.windows([b"ab", b"", b"c"], [bytes(5), bytes(5), b"xyzuv"])
    assert sorted((int(x >> np.uint64(16)), int(x & np.uint64(65535))) for x in found) == sorted([(ord("a"), 0), (ord("a") << 8 | ord("b"), 0), (int.from_bytes(b"xyzuvc", "big"), 2)])
    assert len(context_tree.windows([], [])) == 0


def test_code_lengths(spark, docs, texts):
    found = scored(docs)
    noise = texts.index("x" * 30000)
    assert found[10]["bits_per_byte"] < 8 and found[noise]["learned"] == (zlib.crc32(str(noise).encode()) % 7 != 2)
    for r in found.values():
        assert r["score"] < 0 and r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / r["n_bytes"])


def test_odd_tables(spark, empty, odd):
    assert language_model.score_texts(empty, learn()).count() == 0
    found = language_model.score_texts(odd, learn())
    assert found.columns[:4] == ["doc_id", "learned", "n_tokens", "n_known"] and found.count() == odd.count()
    nothing = language_model.score_texts(odd, F.lit(None).cast("boolean")).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["bits_per_byte"] == pytest.approx(8) for r in nothing)


def test_numbers_are_packed_and_unpacked():
    for x in ([], [0], [5, 3, 1], [1, 2, 1 << 47], [0, 0, 7]):
        assert language_model.loosened(language_model.squeezed(np.array(x, dtype=np.int64))).tolist() == x
