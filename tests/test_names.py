"""Names few edits apart, by blocks of sorted names; pairs of tables by what they take."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import names, scoring
from tests.test_whole import planned


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", (3, 14, 30, 60, 90))
def test_names_of_any_length_are_compared_by_bits(most):
    """16, 32 and 64 letters, and beyond; a beginning in common is cut off, whole branches of names go at once."""
    rnd, pool = random.Random(most), {"河流", "河流站点", "河流站点一览"}
    for _ in range(30):
        base = [rnd.choice("ab河") for _ in range(rnd.randrange(1, most))]
        for _ in range(6):
            pool.add("".join(base))
            k = rnd.randrange(len(base) + 1)
            base[k : k + rnd.randrange(2)] = rnd.choice(["", "x", "a"])
    pool = sorted(pool - {""}, key=lambda x: (len(x), x))
    for head in ("", "t" * 9):
        x, y = [head + p for p in pool[::2]], sorted(head + p for p in pool[1::2])
        found = {(x[i], y[k]): e for k, hit, edit in names.near(x, y) for i, e in zip(hit, edit)}
        assert found == {(a, b): n for a in x for b in y if (n := edits(a, b)) <= max(2, max(len(a), len(b)) // 4)}


def test_blocks_end_where_names_differ_soonest():
    pool = [f"red{n:05}" for n in range(1500)] + [f"rod{n:05}" for n in range(1500)]
    assert names._end(pool, 0) == 1500
    assert names._end(["a"] * 9000, 0) <= names.BLOCK and names._end(["a"] * 100 + ["b"], 0) == 101


def test_many_like_names_make_several_blocks(spark):
    """names with a beginning in common were joined on each part of it, each pair with all its letters."""
    df = spark.range(9000).select(F.concat(F.lit("riverstation"), F.format_string("%05d", F.pmod(F.xxhash64("id"), F.lit(60000)))).alias("x")).distinct().select("x", F.concat("x", F.lit("_q")).alias("table"))
    assert names.blocks(df).count() >= 4
    found = names.near_names(df)
    pool = [r["x"] for r in df.collect()]
    counted = {r["n"]: r["count"] for r in found.groupBy("n").count().collect()}
    probe = random.Random(1).sample(pool, 20)
    near = found.filter(F.col("a").isin([f"{p}_q" for p in probe]) | F.col("b").isin([f"{p}_q" for p in probe])).collect()
    want = {(*sorted((f"{p}_q", f"{x}_q")), 0.55 if n <= 2 else 0.35) for p in probe for x in pool if x != p and (n := edits(p, x)) <= 4}
    assert {tuple(r) for r in near} == want and len(near) == len(want)
    assert set(counted) == {0.55, 0.35}
    assert "levenshtein(x" not in planned(scoring.similar_names(df.select("table"))).lower()


def test_edges_of_a_jaccard_join_few_columns(spark):
    """mirrors need edges of .9 alone, and joined all of .15."""
    rnd = random.Random(4)
    sets = [[f"c{i}" for i in range(s, s + n) if i != g] for s in range(3) for n in (3, 9, 10, 11, 20, 21, 40) for g in (-1, s, s + 5, s + 8)]
    df = spark.createDataFrame([(f"t{rnd.randrange(10**6)}_{k}", c, "at") for k, c in enumerate(sets)], "table string, columns array<string>, time_column string")
    found = sorted(map(tuple, scoring.pairs(df, 0.9).collect()))
    assert found == sorted(tuple(r) for r in scoring.pairs(df).collect() if r["jaccard"] >= 0.9) and {0.9, 1.0} <= {r[3] for r in found}
    assert spark.createDataFrame(found).count() < scoring.pairs(df).count()


def test_mirrors_of_one_structure_take_few_bytes(spark, tmp_path):
    """pairs went through all of a structure's tables for each backup, and took two bytes and more each."""
    df = spark.range(6000).select(F.concat(F.lit("t"), "id", F.when(F.col("id") % 10 == 0, "_bak").otherwise("")).alias("table"), F.lit("f").alias("fingerprint"))
    none = spark.createDataFrame([], "a string, b string, jaccard double")
    found = scoring.mirrors(df, none)
    found.write.parquet(str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).distinct().count() == found.count() == 600 * 5400
    assert sum(f.stat().st_size for f in (tmp_path / "m").glob("*.parquet")) < 600 * 5400


def test_duplicates_of_one_structure_take_few_bytes(spark, tmp_path):
    """pairs of like tables came in no order, and took two bytes and more each."""
    kind = F.element_at(F.array(F.lit("_day"), F.lit("_hour"), F.lit("")), (F.col("id") % 3 + 1).cast("int"))
    df = spark.range(4000).select(F.concat(F.lit("t"), "id", kind).alias("table"), (F.lit(10000) + F.pmod(F.xxhash64("id"), F.lit(900))).alias("rows"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)).cast("double").alias("score"), F.lit("f").alias("fingerprint"), F.lit("d").alias("data_fingerprint"), F.lit(9).alias("sampled"))
    scoring.duplicates(df, tables=4000).write.parquet(str(tmp_path / "d"))
    marks = [4000 // 3 + (k < 4000 % 3) for k in range(3)]
    pairs = 4000 * 3999 // 2 - marks[0] * marks[1]
    found = spark.read.parquet(str(tmp_path / "d"))
    assert found.count() == found.distinct().count() == pairs
    assert sum(f.stat().st_size for f in (tmp_path / "d").glob("*.parquet")) < 1.2 * pairs
