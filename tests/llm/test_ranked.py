"""Ranked search against brute force and SQL; bisection; odd tables."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bisection, ranked
from sparkloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, items, k=10):
    docs = {i: TERM.findall((t or "").translate(LOWER)) for i, t in texts}
    sizes = {i: len(w) for i, w in docs.items() if w}
    n_docs, total = len(sizes), sum(sizes.values())
    tfs = {i: Counter(w) for i, w in docs.items()}
    df = Counter(t for c in tfs.values() for t in c)
    out = {}
    for item, text in items:
        scores = []
        for i, c in tfs.items():
            m = 100 - 90 + (90 * sizes.get(i, 0) * n_docs) // max(1, total)
            scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in c), i))
        out[item] = [(r + 1, i, -x) for r, (x, i) in enumerate(sorted(scores)[:k]) if x < 0]
    return {i: x for i, x in out.items() if x}


def as_dict(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"])):
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


ITEMS = [(1, "w1 w2 w3 w4"), (2, "The naïve Élan"), (3, None), (4, ""), (5, "日本語 x²"), (6, "nothing-like-this"), (7, "a A a"), (8, " ".join(f"w{i}" for i in range(0, 400, 7))), (9, "CC BY 4 0")]


@pytest.mark.parametrize("settings", [ranked.Settings(), ranked.Settings(shard=8, cluster=2, sample=20, levels=2, items=3), ranked.Settings(shard=16, cluster=4, terms=10)])
def test_ranks_match_brute_force(spark, docs, texts, settings):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert as_dict(ranked.rank(docs, items, settings=settings)) == brute(list(enumerate(texts)), ITEMS)


def test_ties_go_to_the_smaller_id(spark):
    texts = [(i, "same words here") for i in range(60, 0, -1)] + [(i, "other things") for i in range(100, 140)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "same here"), (2, "things")], "item_id long, text string")
    for s in (ranked.Settings(), ranked.Settings(shard=10, cluster=3)):
        found = as_dict(ranked.rank(docs, items, settings=s))
        assert [i for _, i, _ in found[1]] == list(range(1, 11)) and [i for _, i, _ in found[2]] == list(range(100, 110))
        assert found == brute(texts, [(1, "same here"), (2, "things")])


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ranked.RANK_SQL).fetchall()
    found = [tuple(r) for r in QUERIES["op12_ranked_search"](spark, SF).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(found) == sorted(want)


def test_a_shard_stops_early_and_exactly():
    """Clusters of topics: few are visited, and the best are those of a full pass."""
    rng = np.random.default_rng(3)
    n, topics = 1024, 16
    rows = [(i, 20 * (i % topics) + t) for i in range(n) for t in rng.choice(20, 6, replace=False)]
    doc, term = np.array(rows).T
    impact = rng.integers(1, 1000, len(doc))
    order, _ = bisection.bisected(doc, term, n, 20 * topics, 5)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    visits = {}
    for name, at, ids in (("bisected", place[doc], order), ("given", doc, np.arange(n))):
        by = np.lexsort((at, term))
        shard, visits[name] = ranked.Shard(ids, at[by], term[by], impact[by], 32), 0
        for q in range(topics):
            terms = 20 * q + np.arange(5)
            full = np.bincount(doc, np.where(np.isin(term, terms), impact, 0), n).astype(np.int64)
            want = [i for i in np.lexsort((np.arange(n), -full)) if full[i] > 0][:10]
            found, scores = shard.search(terms, 10, 1)
            assert found.tolist() == want and scores.tolist() == full[want].tolist()
            bounds = shard.most[np.isin(shard.terms, terms)].sum(axis=0)
            visits[name] += int((bounds >= scores[-1]).sum())
    assert visits["bisected"] * 4 <= visits["given"]


def test_bisection_gathers_documents_of_a_topic():
    rnd = random.Random(1)
    rows = [(i, 10 * (i % 8) + rnd.randrange(10)) for i in range(400) for _ in range(6)]
    doc, term = np.array(sorted(set(rows))).T
    order, halves = bisection.bisected(doc, term, 400, 80, 3)
    assert sorted(order.tolist()) == list(range(400)) and len(halves) == 3
    parts = [Counter(int(i) % 8 for i in order[k : k + 50]) for k in range(0, 400, 50)]
    assert sum(max(p.values()) for p in parts) >= 300
    split = bisection.Splitter(doc, term, 400, 80, 3)
    leaves = split.leaves(doc, term, 400)
    assert np.mean([Counter(leaves[np.arange(400) % 8 == k].tolist()).most_common(1)[0][1] for k in range(8)]) >= 30
    assert bisection.bisected(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0, 1, 2)[0].tolist() == []


def test_odd_tables(spark, empty, odd):
    items = spark.createDataFrame([(1, "a b x", 3, "r"), (1, "a b x", 3, "r"), (None, "c", 4, "s")], "item_id long, text string, score long, rank string")
    assert ranked.rank(empty, items).count() == 0 and ranked.rank(odd, items.limit(0)).count() == 0
    found = sorted((r["item_id"] or 0, r["doc_id"]) for r in ranked.rank(odd, items).collect())
    assert found == [(0, 1), (0, 1), (0, 3), (1, 1), (1, 1), (1, 1), (1, 1), (1, 3), (1, 3)]
    assert ranked.rank(odd, items).columns == ["item_id", "rank", "doc_id", "score"]
