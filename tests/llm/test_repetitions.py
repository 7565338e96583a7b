"""Runs of repeated words against brute force and SQL, and on odd tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import repetitions
from sparkloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(w):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.append((s, i - s + q, q))
            i = max(i, s + 1)
    return sorted((s, n, q) for s, n, q in out if not any(all(w[s + k] == w[s + k + p] for k in range(n - p)) for p in range(1, q)))


def periodic(rnd, n, words):
    w = [rnd.choice(words) for _ in range(n)]
    if n and rnd.random() < 0.6:
        a = rnd.randrange(n)
        p = 1 + (n - a) // (3 + rnd.randrange(8))
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def test_runs_match_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        texts = [periodic(rnd, rnd.randrange(90), range(rnd.choice((1, 2, 3, 20)))) for _ in range(rnd.randrange(1, 6))]
        codes, sizes = np.array([x for w in texts for x in w], dtype=np.int64), np.array([len(w) for w in texts], dtype=np.int64)
        found = {}
        for k, *run in zip(*(x.tolist() for x in repetitions.runs_of(codes, sizes))):
            found.setdefault(k, []).append(tuple(run))
        assert [found.get(k, []) for k in range(len(texts))] == [brute(w) for w in texts]


def test_classes_are_those_of_equal_factors():
    rnd = random.Random(5)
    for _ in range(40):
        texts = [periodic(rnd, rnd.randrange(24, 60), "ab") for _ in range(3)]
        sizes = np.array([len(w) for w in texts])
        p = repetitions.Partition(np.array([ord(x) for w in texts for x in w]), sizes)
        for length in range(2, int(sizes.min()) // 4 + 1):
            p.refine(length)
            want = {}
            for k, w in enumerate(texts):
                for i in range(len(w) - length + 1):
                    want.setdefault((k, tuple(w[i : i + length])), []).append(int(p.least[k]) + i)
            for places in want.values():
                assert len({int(p.cls[i]) for i in places}) == 1
                assert [int(p.after[i]) for i in places] == [*places[1:], -1]
                assert sorted(p.members[p.start[p.cls[places[0]]] :][: p.size[p.cls[places[0]]]].tolist()) == places


def test_work_grows_as_n_log_n(monkeypatch):
    """Positions that are looked at over all lengths: few for each word, even where everything repeats."""
    seen, refine = [0], repetitions.Partition.refine

    def counted(self, length):
        seen[0] += len(self.small)
        return refine(self, length)

    monkeypatch.setattr(repetitions.Partition, "refine", counted)
    for codes in (np.zeros(4000, dtype=np.int64), np.arange(4000) % 37, np.random.default_rng(2).integers(0, 3, 4000)):
        seen[0] = 0
        repetitions.runs_of(codes, np.array([4000]))
        assert seen[0] <= 4000 * 14


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({repetitions.RUNS_SQL})").fetchall()
    found = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).select(*cols).collect()]
    assert sorted(found) == sorted(want) and any(r[1] for r in want)


def test_planted_texts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts * 8)), "doc_id long, text string")
    moved = 0
    for r in rows.select("doc_id", "text", repetitions.planted(F.col("doc_id"), F.col("text")).alias("new")).collect():
        h, w = zlib.crc32(str(r["doc_id"]).encode()), (r["text"] or "").encode().split()
        if h % 10 or not w:
            assert r["new"] == r["text"]
            continue
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        moved += 1
        assert r["new"].encode().split() == [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
    assert moved > 10


@pytest.mark.parametrize("batch", [1 << 20, 50])
def test_operator(spark, docs, texts, batch, monkeypatch):
    monkeypatch.setattr(repetitions, "BATCH_WORDS", batch)
    found = {r["doc_id"]: r for r in repetitions.periodic_runs(docs).collect()}
    for i, t in enumerate(texts):
        w, r = (t or "").encode().split(), found[i]
        want = brute(w) if len(w) < 1000 else [tuple(x) for x in r["runs"]]
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert [tuple(x) for x in r["runs"]] == want and r["n_runs"] == len(want) and r["collapsed"].encode() == left
        assert r["collapsed_sha256"] == hashlib.sha256(left).hexdigest()
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        best = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2])) if want else (None,) * 3
        assert (r["start"], r["length"], r["period"]) == best


def test_odd_tables(spark, empty, odd):
    assert repetitions.periodic_runs(empty).count() == 0
    found = repetitions.periodic_runs(odd).collect()
    assert len(found) == odd.count() and all(r["n_runs"] == 0 and r["start"] is None for r in found)
    assert odd.select(repetitions.planted(F.col("doc_id"), F.col("text"))).count() == odd.count()
