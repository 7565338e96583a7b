import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import corpus, dataset, describe, monitoring, scoring, shaping, transforms
from sparkloom.plans import planner
from sparkloom.sources import tables
from sparkloom.streaming import episodes

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_boxplot_hinges_leave_out_the_median(spark):
    df = frame(spark, [("a", str(v)) for v in (1, 2, 3, 4, 5)] + [("b", str(v)) for v in (1, 2, 3, 4)], "g string, v string")
    got = {r["g"]: tuple(r)[1:] for r in transforms.boxplot_summary(df, "g", "v").collect()}
    assert got == {"a": (1, 1.5, 3, 4.5, 5), "b": (1, 1.5, 2.5, 3.5, 4)}


def test_group_by_sum_rules(spark):
    df = frame(spark, [("a", "1", "x"), ("a", "", None), ("b", "n/a", "?"), (None, "5", "1"), ("", "5", "1"), ("c", "2.5", "y")], "g string, v string, w string")
    assert {r["g"]: (r["v"], r["w"]) for r in transforms.group_by_sum(df, "g", ["v", "w", "v", "none"]).collect()} == {"a": (1, 0), "c": (2.5, 0)}


@pytest.mark.parametrize("call,code", [
    (lambda d: transforms.group_by_sum(d, None, ["v"]), "missing_xField"), (lambda d: transforms.group_by_sum(d, "g", []), "missing_yFields"), (lambda d: transforms.group_by_sum(d, "g", ["z"]), "no_valid_yFields"),
    (lambda d: transforms.boxplot_summary(d, "g", "v"), "insufficient_samples_a"), (lambda d: transforms.boxplot_summary(d.withColumnRenamed("g", "max"), "max", "v"), "xField_conflicts_with_stat_fields"),
    (lambda d: transforms.matrix_aggregate(d, "g", "g", "v"), "field_conflict"), (lambda d: transforms.matrix_aggregate(d, "g", "v", ""), "missing_valueField"), (lambda d: transforms.transform(d, "percent_of_total"), "unsupported_transform_percent_of_total")])
def test_error_codes(spark, call, code):
    with pytest.raises(transforms.TransformError) as e:
        call(frame(spark, [("a", 1.0)], "g string, v double"))
    assert e.value.code == code


def test_29_of_30_slots(spark):
    day, end = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")
    want = frame(spark, [(1, 0, 1), (1, 1, 4)], "station_id long, code int, hours int").select("station_id", "code", F.explode(monitoring.slots(day, end, F.col("hours"))).alias("slot"))
    facts = want.filter("NOT (code = 1 AND slot = TIMESTAMP '2024-01-01 08:00:00')").withColumn("value", F.hour("slot").cast("double"))
    got = monitoring.completeness(want, facts).agg(F.sum("valid"), F.sum("expected")).first()
    assert tuple(got) == (29, 30)


def test_days_merge_and_long_runs_count_once(spark):
    day = lambda k: dt.date(2024, 2, 26) + dt.timedelta(k)
    got = monitoring.ranges(frame(spark, [(1, day(k)) for k in (1, 2, 4)], "s int, day date"), ["s"], "day").orderBy("first_day").collect()
    assert [(r["first_day"], r["last_day"]) for r in got] == [(day(1), day(2)), (day(4), day(4))]
    spine = frame(spark, [(1, day(k), 0 <= k < 8) for k in range(-2, 20)], "s int, day date, hit boolean")
    assert monitoring.episodes(spine, ["s"], "day", "hit", 7, F.lit(day(3)), F.lit(day(30))).first()["episodes"] == 1


def test_grades(spark):
    df = frame(spark, [("III类", "II"), ("v", "I"), ("劣V类", "劣Ⅴ"), (None, "I"), (" Ⅰ ", "II")], "a string, b string")
    assert [r[0] for r in df.select(monitoring.compare(F.col("a"), F.col("b"))).collect()] == [monitoring.WORSE, monitoring.NO_DATA, monitoring.SAME, monitoring.NO_DATA, monitoring.BETTER]


def test_similar_names(spark):
    pairs = [("t_river", "river_bak", 1.0), ("station_info", "station_info_list", 0.7), ("abcd", "abcf", 0.55), ("x", "", 0.0), ("measurements", "banana", 0.0)]
    got = frame(spark, pairs, "a string, b string, n double").select("n", scoring.name_similarity(F.col("a"), F.col("b")).alias("m")).collect()
    assert all(r["n"] == r["m"] for r in got), got


def test_archetypes():
    base = dict(rows=6, measures=1, dimensions=1, times=0, identifiers=0, heterogeneous=0, detail=0, aggregated=True, entity=False, entities=0, time_points=0, multi_series=False, matrix=False, duplicates=False)
    cases = [({"rows": 0}, "empty"), ({"rows": 1}, "single_value"), ({"rows": 1, "measures": 3}, "single_row_multi_measure"), ({"identifiers": 1}, "detail_rows"), ({}, "categorical_series"), ({"dimensions": 2, "matrix": True}, "categorical_matrix"),
             ({"dimensions": 0, "measures": 2}, "numeric_relationship"), ({"dimensions": 0, "times": 1, "time_points": 12}, "temporal_series"), ({"heterogeneous": 0.7}, "heterogeneous_metric_rows"),
             ({"entity": True, "times": 1, "entities": 2, "time_points": 3, "multi_series": True}, "multi_series_temporal"), ({"duplicates": True}, "unknown")]
    for change, want in cases:
        assert dataset.archetype(base | change) == want


def test_planner():
    found = planner.plans("categorical_series", {"measures": 1, "categories": 5, "part_to_whole": True})
    assert [v.chart for _, v in found] == ["bar", "pie", "donut"] and planner.choose(found).chart == "bar" and planner.choose(found, user="pie").chart == "pie"
    assert planner.plans("categorical_series", {"measures": float("nan")}) == [] and planner.choose([]) is None


def test_summary_of_mixed_signs(spark):
    got = describe.summary(frame(spark, [("a", 4.0), ("b", -2.0), ("c", None)], "x string, y double"), "x", "y").first()
    assert (got["n"], got["total"], got["ratio"], got["most_at"]) == (2, 2.0, None, "a")


def test_ratio_and_sort_keys(spark):
    df = frame(spark, [("river", "rivers")], "a string, b string").select(corpus.ratio(F.col("a"), F.col("b"))).first()[0]
    assert round(df, 4) == 0.9091
    keys = frame(spark, [("2024-02-01",), ("2024Q3",), ("11月",), ("Q2",), ("7.5",), ("x",)], "x string").select(shaping.sort_key(F.col("x"))).collect()
    assert [k[0] for k in keys] == [1706745600000.0, 20243.0, 11.0, 2.0, 7.5, None]


def test_sinks(spark, tmp_path):
    df = tables.table(spark, SF, "nation")
    path = tables.write_csv(df.filter("n_nationkey < 0"), str(tmp_path))
    assert spark.read.option("header", True).csv(path).count() == 0
    assert tables.records(df.limit(0))["columns"] == df.columns
    assert tables.write_snapshot(spark, {"a": 1}, str(tmp_path / "s")) == tables.write_snapshot(spark, {"a": 1}, str(tmp_path / "s"))
    one, other = tables.manifest(spark, str(tmp_path / "s")), tables.manifest(spark, str(tmp_path / "s")).limit(0)
    assert tables.compare_manifests(one, other).filter("state = 'missing'").count() == one.count() > 0
    assert tables.metadata(spark, SF, ("nation",)).count() == 3 and tables.sample(df, ["n_nationkey"], 5).count() == 5


def test_streaming_episodes(spark, tmp_path):
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(k), k % 7 != s) for s in (1, 2) for k in range(20)]
    frame(spark, rows, "station_id long, day date, matched boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("station_id long, day date, matched boolean").parquet(str(tmp_path / "in"))
    query = episodes.episode_starts(stream, 4).writeStream.format("memory").queryName("starts").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.table("starts").groupBy("station_id").count().orderBy("station_id").collect() == [(1, 3), (2, 2)]


def test_samples_that_run(spark):
    from sparkloom.operators import catalogue

    spark.createDataFrame([(1, "a")], "id int, name string").createOrReplaceTempView("sampled")
    rows = [("x1", "sampled", "SELECT `name`, `id` FROM `sampled` LIMIT 5"), ("x2", "gone", "SELECT `id` FROM `gone` LIMIT 5"), ("x3", "sampled", "SELECT `id` / 0 AS z FROM `sampled` WHERE raise_error('no') IS NULL LIMIT 5")]
    assert catalogue.verified(spark, spark.createDataFrame(rows, "sample_id string, table string, sql string")) == ["x1"]


def test_semantics_of_shapes(spark):
    from sparkloom.operators import semantics

    facts = [(0, 3, 1, None, 0, 0, 0), (3, 1, 1, "entity", 1, 1, 1), (3, 6, 1, "entity", 2, 3, 3), (2, 6, 1, None, 0, 0, 6), (3, 6, 2, "other", 2, 3, 0), (3, 5, 1, "other", 5, 1, 0)]
    df = spark.createDataFrame(facts, "columns int, rows int, measures int, by string, values int, most int, times int").coalesce(1)
    assert [r["shape"] for r in semantics.shape(df).collect()] == ["empty", "single_value", "multi_entity_time_series", "single_entity_time_series", "relationship", "cross_section"]


def test_field_selectors():
    from sparkloom.plans import charts

    shape = charts.Shape(("site", "month", "n", "ph", "x"), measures=("n", "ph"), dimensions=("site", "month"), temporal=("month",), numeric=("n", "ph", "x"), entity="site", kinds={"n": "additive", "ph": "non_additive"})
    asked = charts.Preferred(x="gone", ys=("ph", "gone"), value="n")
    assert [charts.scalar(s, shape, asked) for s in ("entity", "region", "preferred_x", "preferred_y", "preferred_value", "additive_measure", "non_additive_measure")] == ["site", None, None, "ph", "n", "n", "ph"]
    assert charts.scalar("numeric", shape, exclude=("n", "ph")) == "x" and charts.scalar("measure", shape, index=5) is None
    assert charts.several("measures", shape, after=0) == ("ph",) and charts.several("dimensions", shape, most=1) == ("site",) and charts.several("preferred_ys", shape, asked) == ("ph",)
    with pytest.raises(ValueError):
        charts.scalar("other", shape)


def test_charts_from_plan_to_rows(spark):
    from sparkloom.plans import charts

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 5.0)], "site string, ph double")
    shape = charts.Shape(("site", "ph"), measures=("ph",), dimensions=("site",), numeric=("ph",), kinds={"ph": "non_additive"})
    made = charts.prepare(df, "detail_rows", {"grouped_samples": True}, shape)
    assert made.error is None and made.variant.chart == "boxplot" and made.rows.columns == ["site", "min", "Q1", "median", "Q3", "max"]
    assert charts.prepare(df, "detail_rows", {}, shape).error == "no_default_plan"
    assert charts.prepare(df, "detail_rows", {"grouped_samples": True}, charts.Shape(("site", "ph"), measures=("ph",))).error == "selected_plan_missing_spec"
    one = df.limit(1)
    assert charts.prepare(one, "detail_rows", {"grouped_samples": True}, shape).error == "transform_failed_insufficient_samples_a"
    can = charts.availability("detail_rows", {"grouped_samples": True}, shape)
    assert can["boxplot"]["supported"] and can["pie"]["reason"] == "unsuitable_data"
    assert charts.compact("pie", 7) == (False, False) and charts.compact("bar", 7) == (True, True)


def test_jobs_within_a_budget(spark):
    import time

    from sparkloom.plans import budget

    slow = lambda: spark.range(0, 4, 1, 4).selectExpr("reflect('java.lang.Thread', 'sleep', 20000L) AS x").count()
    sleepy = lambda: spark.range(0, 4, 1, 4).mapInPandas(lambda it: ((time.sleep(20), x)[1] for x in it), "id long").count()
    found = budget.within(spark, {"a": lambda: spark.range(5).count(), "slow": sleepy, "bad": lambda: spark.sql("SELECT gone"), "b": lambda: spark.range(7).count()}, each=4)
    assert [found[k].state for k in ("a", "slow", "bad", "b")] == ["done", "timed_out", "failed", "done"] and found["b"].value == 7
    assert {o.state for o in budget.within(spark, {"a": slow}, total=0).values()} == {"skipped"}


def test_records_say_that_rows_are_missing(spark):
    from sparkloom.sources import tables

    held = tables.records(spark.range(5), limit=3)
    assert (held["row_count"], held["truncated"], len(held["rows"])) == (3, True, 3) and not tables.records(spark.range(3), limit=3)["truncated"]


def test_last_frame_of_a_long_conversation(spark):
    """One message holds nearly all rows; each chart gets the last frame that isn't empty, whatever ranges cut the order."""
    import random

    from sparkloom.operators import logs

    rnd = random.Random(2)
    frames = [("m" if k % 9 else f"n{k % 5}", k, [{"a": str(k)}] * rnd.randrange(3)) for k in rnd.sample(range(4000), 900)] + [(None, 3, [{"a": "x"}])]
    charts = [(rnd.choice(["m", "m", "m", "n1", "n2", "gone", None]), rnd.randrange(4000)) for _ in range(300)] + [("m", 0), ("m", 0)]
    data = spark.createDataFrame(frames, "message string, place long, rows array<map<string,string>>")
    found = logs.rehydrate(spark.createDataFrame(charts, "message string, place long"), data).collect()

    def want(message, place):
        own = [(k, rows) for m, k, rows in frames if m is not None and m == message and k <= place and rows]
        return max(own)[1] if own else None

    assert len(found) == len(charts)
    assert all(r["rows"] == want(r["message"], r["place"]) for r in found)


@pytest.mark.parametrize("ranges", [1, 3, 17])
def test_values_carried_along_an_order(spark, ranges):
    from sparkloom.functions.ordered import last_before

    rows = [(k, i, i if (i * 7 + len(k or "")) % 5 == 0 else None, "x") for k in ("a", "bb", None) for i in range(60)]
    found = last_before(spark.createDataFrame(rows, "k string, i long, v long, other string"), ["k"], ["i"], "v", ranges).collect()
    want = {}
    for k, i, v, _ in rows:
        want[k, i] = v if v is not None else want.get((k, i - 1))
    assert {(r["k"], r["i"]): r["v"] for r in found} == want and len(found) == len(rows)


def test_groups_of_long_chains_take_few_rounds(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    names = [f"t{i:04d}" for i in range(300)]
    chain = names[:200]
    rnd.shuffle(chain)
    edges = [(min(x), max(x)) for x in zip(chain, chain[1:])] + [(names[250], names[251]), (names[260], names[270]), (names[251], names[260])]
    found = {r["table"]: r["root"] for r in scoring.groups(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {found[x] for x in chain} == {min(chain)} and found[names[270]] == names[250] and len(found) == 204


def test_group_names_are_common_beginnings(spark):
    rows = [("t_waterquality_a", "t_waterquality_a"), ("t_waterquality_b", "t_waterquality_a"), ("tb_waterlevel", "t_waterquality_a"), ("x_1", "x_1"), ("y_2", "x_1"), ("waterquality", "waterquality"), ("waterqualities", "waterquality")]
    edges = [("t_waterquality_a", "t_waterquality_b", 0.9, 0.5), ("t_waterquality_b", "tb_waterlevel", 0.6, 0.7), ("x_1", "y_2", 1.0, 1.0), ("waterquality", "waterqualities", 0.8, 0.4)]
    found = {r["root"]: (r["name"], r["members"], r["confidence"], r["jaccard"]) for r in scoring.summaries(spark.createDataFrame(edges, "a string, b string, confidence double, jaccard double"), spark.createDataFrame(rows, "table string, root string")).collect()}
    assert found == {"t_waterquality_a": ("waterqualitya", 3, 0.6, 0.5), "x_1": ("x", 2, 1.0, 1.0), "waterquality": ("waterqualit", 2, 0.8, 0.4)}
