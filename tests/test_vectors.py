"""The vector store against a full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import corpus
from sparkloom.sources.vectors import Plan, VectorStore


def table(spark, n=3000, start=0, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, 24))
    x = centres[rng.integers(0, 20, n)] + 0.35 * rng.standard_normal((n, 24))
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>"), x


def keys(df):
    return [(r[0], round(r[1], 6)) for r in df.collect()]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows, x = table(spark)
    odd = spark.createDataFrame([(9001, None), (9002, [0.0] * 24), (9003, [1.0] * 3), (9004, [float("nan")] * 24), (None, [1.0] * 24), (9005, [1.0] * 23 + [None])], rows.schema)
    folder = str(tmp_path_factory.mktemp("store") / "s")
    return VectorStore.create(rows.unionByName(odd), folder, plan=Plan(cells=24, sample=1000)), rows, x


def test_searches_are_those_of_a_scan(store):
    own, rows, x = store
    for i in (0, 5, 77, 1234):
        q = (x[i] + 0.1).tolist()
        for k, least in ((10, 0.1), (3, 0.55), (5, 0.99)):
            assert keys(own.search(q, k, least)) == keys(corpus.similar(rows, q, k, least))


def test_approximate_recall_and_rows_read(store):
    own, rows, x = store
    hits = total = 0
    for i in range(0, 60, 3):
        want = {k for k, _ in keys(corpus.similar(rows, x[i].tolist(), 10, 0.0))}
        hits += len(want & {k for k, _ in keys(own.search(x[i].tolist(), 10, 0.0, probes=3))})
        total += len(want)
    assert hits >= 0.9 * total
    q = x[0] / np.sqrt((x[0] ** 2).sum())
    sizes = {c: n for c, _, n in own.cells()}
    near = sorted(sizes, key=lambda c: -float(own.centres[c] @ q))[:3]
    assert sum(sizes.values()) == 3000 and sum(sizes[c] for c in near) <= 0.35 * 3000


def test_only_the_cells_and_columns_that_count_are_read(store):
    own, _, x = store
    plan = own._codes(x[0], [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters")[1][:80] and "vector" not in plan.split("ReadSchema")[1]


def test_a_second_session_adds_and_finds(spark, store, tmp_path):
    rows, x = table(spark, 400)
    VectorStore.create(rows, str(tmp_path / "s"), plan=Plan(cells=8, pieces=5, codes=16))
    again = VectorStore(spark.newSession(), str(tmp_path / "s"))
    more, y = table(spark, 300, 1000, seed=7)
    again.add(more)
    both = rows.unionByName(more)
    for q in (x[3].tolist(), y[3].tolist()):
        assert keys(again.search(q, 7, 0.2)) == keys(corpus.similar(both, q, 7, 0.2))


def test_ties_repeats_text_keys_and_empty_stores(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", [1.0, 2.0] if i < 8 else [2.0, -1.0]) for i in range(10)], "name string, v array<double>")
    own = VectorStore.create(rows, str(tmp_path / "t"), key="name", vector="v")
    assert [k for k, _ in keys(own.search([1.0, 2.0], 3, 0.5))] == ["k0", "k1", "k2"]
    assert own.search([0.0, 0.0], 3).count() == own.search([1.0], 3).count() == 0
    none = VectorStore.create(rows.limit(0), str(tmp_path / "n"), key="name", vector="v")
    assert none.search([1.0, 2.0], 3).count() == 0
    none.add(spark.createDataFrame([("a", [3.0])], rows.schema), key="name", vector="v")
    assert keys(none.search([1.0], 3)) == [("a", 1.0)]
