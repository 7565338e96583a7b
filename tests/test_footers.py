"""Statistics from footers against those of the data."""

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import footers, tables

SF = "/root/testdata/sf0.001"


def test_footers_say_what_the_data_says(spark, tmp_path):
    rows = [(i, i * 0.5 if i % 3 else None, f"t{i}" if i % 5 else None, [i], i % 2 == 0) for i in range(1000)]
    spark.createDataFrame(rows, "k long, v double, t string, a array<int>, b boolean").repartition(5).write.parquet(str(tmp_path / "x"))
    found = {r["column"]: r for r in footers.statistics(spark, {"x": str(tmp_path / "x")}, keys=lambda t: ["k"]).collect()}
    assert {r["rows"] for r in found.values()} == {1000}
    assert (found["k"]["low"], found["k"]["high"], found["k"]["nulls"], found["k"]["primary_key"]) == ("0", "999", 0, True)
    assert (found["v"]["low"], found["v"]["high"], found["v"]["nulls"], found["v"]["primary_key"]) == ("0.5", "499.0", 334, False)
    assert (found["t"]["nulls"], found["t"]["low"], found["a"]["nulls"], found["b"]["nulls"]) == (200, None, None, 0)
    assert [found[c]["ordinal_position"] for c in "kvtab"] == [1, 2, 3, 4, 5]


def test_no_data_is_read(spark):
    plan = footers.counted(spark, f"{SF}/orders.parquet")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan and "MIN(o_orderkey)" in plan and "PushedAggregation: []" not in plan


def test_a_broken_table_has_a_row_of_its_own(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 this is none PAR1")

    def keys(table):
        if table == "customer":
            raise PermissionError("no rights")
        return tables.KEYS[table]

    found = footers.statistics(spark, {"bad": str(tmp_path / "bad.parquet"), "gone": str(tmp_path / "gone"), "nation": f"{SF}/nation.parquet", "customer": f"{SF}/customer.parquet"}, keys).collect()
    errors = {r["table"]: r["error"] for r in found if r["error"]}
    assert set(errors) == {"bad", "gone"} and all(r["rows"] is None for r in found if r["error"])
    assert {r["column"] for r in found if r["table"] == "nation" and r["primary_key"]} == {"n_nationkey"}
    assert [r["rows"] for r in found if r["table"] == "customer"] == [150] * 5 and not any(r["primary_key"] for r in found if r["table"] == "customer")


def test_empty_tables(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert [(r["rows"], r["nulls"], r["low"]) for r in footers.statistics(spark, {"none": str(tmp_path / "none")}).collect()] == [(0, 0, None)]
    assert footers.statistics(spark, {}).count() == 0
