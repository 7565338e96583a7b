"""The station repository: what is read, and how little."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.sources.stations import StationRepository

HOURLY = "id long, station_id long, monitor_time timestamp, status string, water_quality_level string, del_flag string, m1_value double, m2_value double"


@pytest.fixture(scope="module")
def repository(spark, tmp_path_factory):
    own = StationRepository(spark, str(tmp_path_factory.mktemp("stations")))
    rows = [(i, i % 7, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), "ok", "Ⅱ", "1" if i % 11 == 0 else "0", float(i), -float(i)) for i in range(1500)]
    own.write("hourly", spark.createDataFrame(rows, HOURLY).repartition(6))
    own.write("stations", spark.createDataFrame([(1, "a", "river", "0"), (2, "b", "lake", "0"), (3, "c", "river", "1")], "id long, station_name string, station_type string, del_flag string"))
    targets = [(1, 5, 2024, 0, "Ⅲ", "0"), (2, 5, 2024, 0, "Ⅱ", "0"), (3, 5, 2024, 3, "Ⅳ", "0"), (4, 5, 2023, 0, "Ⅰ", "0"), (9, 5, 2024, 0, "Ⅴ", "1"), (5, 6, 2024, 4, "Ⅰ", "0")]
    own.write("targets", spark.createDataFrame(targets, "id long, section_id long, year int, month int, water_quality_target_level string, del_flag string"))
    return own, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_half_open_periods(repository):
    own, rows = repository
    start, end = dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 10, 5)
    found = own.readings("hourly", start, end, [1])
    assert found.columns[-1] == "m2_value" and "m1_value" not in found.columns
    assert sorted(r["id"] for r in found.collect()) == [r[0] for r in rows if start <= r[2] < end and r[5] == "0"]
    text = plan(found)
    assert "PartitionFilters: [isnotnull(month" in text and "202402" in text and "m1_value" not in text.split("ReadSchema")[1]
    assert found.select("station_id").distinct().count() == 7


def test_periods_of_a_table_prune_months_when_they_run(spark, repository):
    own, rows = repository
    spans = [("p", dt.datetime(2024, 1, 30), dt.datetime(2024, 2, 2)), ("q", dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 1, 11)), ("none", dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 1)), ("year", dt.datetime(2024, 2, 1, 1), dt.datetime(2024, 2, 1, 1))]
    periods = spark.createDataFrame(spans, "period string, start timestamp, end timestamp").filter(F.col("period") != "year")
    found = own.readings_of("hourly", periods, [0])
    assert "dynamicpruning" in plan(found)
    want = sorted((p, r[0]) for p, a, b in spans for r in rows if a <= r[2] < b and r[5] == "0")
    assert sorted((r["period"], r["id"]) for r in found.collect()) == want and want


def test_months_are_replaced_alone(spark, repository, tmp_path):
    own = StationRepository(spark, str(tmp_path))
    row = lambda i, month, v: (i, 1, dt.datetime(2024, month, 3), "ok", "Ⅱ", "0", v, v)
    own.write("daily", spark.createDataFrame([row(1, 1, 1.0), row(2, 2, 2.0)], HOURLY))
    own.replace_months("daily", spark.createDataFrame([row(3, 2, 9.0)], HOURLY))
    found = own.readings("daily", dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1), [0]).collect()
    assert sorted((r["id"], r["m1_value"]) for r in found) == [(1, 1.0), (3, 9.0)]


def test_stations_and_targets(repository):
    own, _ = repository
    assert sorted(r["id"] for r in own.stations().collect()) == [1, 2] and [r["id"] for r in own.stations(["lake"]).collect()] == [2]
    assert sorted((r["section_id"], r["month"], r["water_quality_target_level"]) for r in own.targets(2024, [3]).collect()) == [(5, 0, "Ⅱ"), (5, 3, "Ⅳ")]
