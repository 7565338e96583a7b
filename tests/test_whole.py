"""Queries over whole tables, against their SQL."""

import random

import duckdb
import pytest

from pyspark.sql import functions as F

from sparkloom import registry
from sparkloom.operators import scoring
from sparkloom.sources.tables import NAMES
from tests.test_oracle import rows

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
#: Queries that are costly in SQL, so they are also compared where groups are larger.
COSTLY = ("T1_score", "T2_volume_bands", "T4_coverage_bands", "T8_decision", "T10_name_similarity", "T13_strong_edges", "T14_components", "T15_group_summary", "T16_shards", "T17_duplicates", "T18_mirrors", "T19_obsolete", "T20_proposals", "T22_review_merge", "T23_decision_counts", "L1_normal_question", "L10_ready", "W6_missing_runs", "W12_targets", "D15_ddl", "M8_families")


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in NAMES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(COSTLY))
def test_query_reads_the_whole_table(spark, con, name):
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, SF)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_edges_of_odd_column_sets(spark):
    sets = [("t_a", ["x"]), ("a_bak", ["x", "y", "z", "u", "v", "w"]), ("b", ["x", "y", "z"]), ("c", ["x", "y", "z", "z"]), ("d", []), ("e", ["q"]), ("same", [f"c{i}" for i in range(20)]), ("same_2", [f"c{i}" for i in range(13, 33)])]
    df = spark.createDataFrame([(t, c, "at") for t, c in sets], "table string, columns array<string>, time_column string")
    assert sorted((r["a"], r["b"]) for r in scoring.pairs(df).collect()) == [("a_bak", "t_a"), ("b", "c"), ("same", "same_2")]


def test_similar_names_of_any_length(spark):
    rnd = random.Random(5)
    names = {"", "t_", "t_a", "b", "河流", "河流站", "a_1", "a_2", "station_info", "station_info_list"}
    for n in (1, 2, 3, 4, 5, 7, 8, 11, 12, 16, 17, 24, 40):
        for _ in range(8):
            base = [rnd.choice("abc") if n < 6 else rnd.choice("abcdefghij") for _ in range(n)]
            names.add("".join(base))
            for _ in range(3):
                near = list(base)
                for _ in range(rnd.randrange(1, max(3, n // 3))):
                    k = rnd.randrange(len(near) + 1)
                    near[k : k + rnd.randrange(2)] = rnd.choice(["", "x", "a"])
                names.add("".join(near))
    df = spark.createDataFrame([(x,) for x in sorted(names)], "table string")
    both = df.select(F.col("table").alias("a")).crossJoin(df.select(F.col("table").alias("b"))).filter("a < b")
    want = both.select("a", "b", scoring.name_similarity(F.col("a"), F.col("b")).alias("n")).filter("n > 0")
    assert sorted(map(tuple, scoring.similar_names(df).collect())) == sorted(map(tuple, want.collect()))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_send_no_table_through_the_driver(spark):
    """by a file's size Spark would broadcast all profiles, and then a million of them."""
    assert "BroadcastHashJoin" not in planned(QUERIES["T13_strong_edges"](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", ("T10_name_similarity", "T17_duplicates", "T18_mirrors"))
def test_pairs_send_no_table_through_the_driver(spark, name):
    """F6, F8, F10: the same of pairs of tables."""
    assert "BroadcastHashJoin" not in planned(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_duplicates_and_mirrors_within_groups(spark):
    """pairs are made within a group; ties of scores keep the lesser name, on either side of a step."""
    rows = [("b", 100, 1.0, "g"), ("a", 109, 1.0, "g"), ("c", 111, 2.0, "g"), ("d", 100, 9.0, "h"), ("e", 0, 1.0, "g"), ("f", 0, 3.0, "g"), ("a_bak", 5, 1.0, "g")]
    df = spark.createDataFrame([(t, n, x, g, "s", "d", 9) for t, n, x, g in rows], "table string, rows long, score double, root string, fingerprint string, data_fingerprint string, sampled int")
    found = lambda *keys: sorted(map(tuple, scoring.duplicates(df, *keys).collect()))
    assert found("root") == [("a", "b"), ("c", "a"), ("c", "b"), ("f", "e")]
    assert found() == [("a", "b"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b"), ("d", "c"), ("f", "e")]
    none = spark.createDataFrame([], "a string, b string, jaccard double")
    assert sorted(r["of"] for r in scoring.mirrors(df, none, "root").collect()) == ["a", "b", "c", "e", "f"] and scoring.mirrors(df, none).count() == 6
    near = spark.createDataFrame([("a", "a_bak", 0.95), ("a_bak", "d", 0.95)], "a string, b string, jaccard double")
    other = df.withColumn("fingerprint", F.col("table"))
    assert sorted(r["of"] for r in scoring.mirrors(other, near).collect()) == ["a", "d"] and [r["of"] for r in scoring.mirrors(other, near, "root").collect()] == ["a"]


def test_a_text_is_parsed_once(spark):
    """the parts of a DDL text were made again for each use within functions of arrays."""
    from sparkloom.operators.catalogue import ddl_keys

    plan = spark.range(1).select(ddl_keys(F.concat(F.lit("create table t (a int); "), F.col("id").cast("string"))).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 3  # the text's tokens, its parts, and the indexes behind it
