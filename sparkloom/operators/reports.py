"""Monitoring reports from the operators of monitoring.py: daily tables, lasting conditions, monthly completeness, subsets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import percent
from ..registry import register
from ..sources.stations import StationRepository
from ..sources.store import shared_folder
from ..sources.tables import table
from .monitoring import _GRADED, GRADES, _daily, _graded, distribution, islands, normal_grade, ordinal, ranges, slots

#: What is said of a station's day.
NOT_SET, NOT_MEASURED, NORMAL, DISABLED = "待配置", "未监测", "正常", "未启用"
#: What is said of a station's month without missing days, and without any reading.
NOTHING_MISSING, WHOLE_MONTH = "无", "整月未监测"
#: Hours and days for which a condition must last.
HOURS_OVER_TARGET, DAYS_OVER_TARGET, DAYS_WORSE = 120, 7, 3


def day_status(stations: DataFrame, indicators: DataFrame, facts: DataFrame, days: Column) -> DataFrame:
    """station_id, day, status, valid, expected of every station on every day.

    stations: station_id. indicators: station_id, code, name, hours. facts: station_id, code, slot, value. days: array of
    dates. The status names each indicator with missing times (runs of them merged) or with at least two readings all the
    same; or it is NORMAL, NOT_MEASURED without any reading, NOT_SET without indicators.
    """
    spine = stations.select("station_id").distinct().select("station_id", F.explode(days).alias("day"))
    wanted = spine.join(indicators.select("station_id", "code", "name", "hours"), "station_id")
    start = F.col("day").cast("timestamp")
    expected = wanted.select("*", F.explode(slots(start, start + F.make_dt_interval(days=F.lit(1)), F.col("hours"))).alias("slot"))
    got = expected.join(facts.select("station_id", "code", "slot", "value"), ["station_id", "code", "slot"], "left")
    keys = ["station_id", "day", "code", "name", "hours"]
    missing = got.filter("value IS NULL").select(*keys, "slot")
    runs = islands(missing, keys, F.floor(F.unix_timestamp("slot") / (3600 * F.greatest("hours", F.lit(1))))).groupBy(*keys, "island").agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
    hour = lambda c: F.date_format(c, "HH")
    label = F.when(F.col("first") == F.col("last"), F.concat(hour("first"), F.lit("时"))).otherwise(F.concat(hour("first"), F.lit("-"), hour("last"), F.lit("时"), F.when(F.col("hours") > 1, F.concat(F.lit("（每"), F.col("hours").cast("string"), F.lit("小时）"))).otherwise("")))
    labels = runs.withColumn("label", label).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "label"))), lambda x: x["label"]), "、").alias("labels"))  # of one indicator's day
    of = got.groupBy(*keys).agg(F.count("*").alias("expected"), F.count("value").alias("valid"), F.count_distinct("value").alias("kinds")).join(labels, keys, "left")
    said = F.when(F.col("labels").isNotNull(), F.concat("name", F.lit("（"), "labels", F.lit("缺测）"))).when((F.col("valid") >= 2) & (F.col("kinds") == 1), F.concat("name", F.lit("（恒值）")))
    whole = of.withColumn("said", said).groupBy("station_id", "day").agg(F.sum("expected").alias("expected"), F.sum("valid").alias("valid"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("code", "said")))), lambda x: x["said"]), "、").alias("said"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    status = F.when(F.col("said").isNull(), NOT_SET).when(F.col("valid") == 0, NOT_MEASURED).when(F.col("said") != "", F.col("said")).otherwise(NORMAL)
    return spine.join(whole, ["station_id", "day"], "left").select("station_id", "day", status.alias("status"), zero("valid"), zero("expected"))


def daily_table(stations: DataFrame, indicators: DataFrame, facts: DataFrame, day: Column, recent: int = 3) -> DataFrame:
    """A row per station: today, yesterday, recent (statuses of the last days, oldest first), valid, expected of today.

    stations: station_id, enabled; those that aren't are DISABLED throughout and count nothing. recent: 2 to 7 days."""
    if not 2 <= recent <= 7:
        raise ValueError("a daily report looks back 2 to 7 days")
    statuses = day_status(stations, indicators, facts, F.sequence(F.date_sub(day, recent - 1), day))
    on = lambda n, c: F.max(F.when(F.col("day") == F.date_sub(day, n), F.col(c)))
    said = statuses.groupBy("station_id").agg(on(0, "status").alias("today"), on(1, "status").alias("yesterday"), F.transform(F.array_sort(F.collect_list(F.struct("day", "status"))), lambda x: x["status"]).alias("recent"), on(0, "valid").alias("valid"), on(0, "expected").alias("expected"))
    e = F.coalesce("enabled", F.lit(False))
    off = lambda c: F.when(e, F.col(c)).otherwise(DISABLED).alias(c)
    none = lambda c: F.when(e, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c)
    return stations.select("station_id", "enabled").join(said, "station_id").select("station_id", off("today"), off("yesterday"), F.when(e, F.col("recent")).otherwise(F.array_repeat(F.lit(DISABLED), recent)).alias("recent"), none("valid"), none("expected"))


def conditions(stations: DataFrame, hourly: DataFrame, daily: DataFrame, day: Column) -> DataFrame:
    """station_id, hours_over, days_over (null without a target), days_worse, inferior: what has lasted up to a day.

    stations: station_id, target (a grade or null). hourly: station_id, slot, grade. daily: station_id, day, grade. A
    missing hour or day ends a condition."""
    aim = stations.select("station_id", normal_grade(F.col("target")).alias("target"))
    end = (F.date_add(day, 1)).cast("timestamp")
    hours = hourly.filter((F.col("slot") < end) & (F.col("slot") >= end - F.make_dt_interval(hours=F.lit(HOURS_OVER_TARGET)))).join(aim, "station_id")
    over = F.count_distinct(F.when(ordinal(F.col("grade")) > ordinal(F.col("target")), F.col("slot"))).alias("h")
    days = daily.filter(F.col("day").between(F.date_sub(day, DAYS_OVER_TARGET - 1), day)).join(aim, "station_id")
    many = lambda c: F.count_distinct(F.when(c, F.col("day")))
    o = ordinal(F.col("grade"))
    by_day = days.groupBy("station_id").agg(many(o > ordinal(F.col("target"))).alias("d"), many((o > 4) & (F.col("day") > F.date_sub(day, DAYS_WORSE))).alias("w"), many((o == 6) & (F.col("day") == day)).alias("i"))
    both = aim.join(hours.groupBy("station_id").agg(over), "station_id", "left").join(by_day, "station_id", "left")
    reached = lambda c, n: F.coalesce(F.col(c), F.lit(0)) == n
    known = F.col("target").isNotNull()
    return both.select("station_id", F.when(known, reached("h", HOURS_OVER_TARGET)).alias("hours_over"), F.when(known, reached("d", DAYS_OVER_TARGET)).alias("days_over"), reached("w", DAYS_WORSE).alias("days_worse"), reached("i", 1).alias("inferior"))


def monthly_completeness(stations: DataFrame, indicators: DataFrame, counts: DataFrame, days: Column) -> DataFrame:
    """station_id, valid, expected, missing: readings of a month against those expected, and the days that lack some.

    stations: station_id, enabled. indicators: station_id, code, name, hours. counts: station_id, code, day, n. More
    readings than expected count as expected; missing names indicators with ranges of days."""
    spine = stations.select("station_id", "enabled").join(indicators, "station_id", "left").select("*", F.explode(days).alias("day"))
    each = F.when(F.col("code").isNull() | (F.col("hours") <= 0), 0).when(F.col("hours") >= 24, 1).otherwise(F.ceil(F.lit(24) / F.col("hours"))).cast("long")
    got = spine.join(counts.select("station_id", "code", "day", "n"), ["station_id", "code", "day"], "left").withColumn("each", each).withColumn("n", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)))
    totals = got.groupBy("station_id").agg(F.first("enabled").alias("enabled"), F.count("code").alias("set"), F.sum(F.least("n", "each")).alias("valid"), F.sum("each").alias("expected"))
    gaps = ranges(got.filter("code IS NOT NULL AND n < each"), ["station_id", "code", "name"], "day")
    label = F.when(F.col("first_day") == F.col("last_day"), F.date_format("first_day", "MM-dd")).otherwise(F.concat(F.date_format("first_day", "MM-dd"), F.lit("~"), F.date_format("last_day", "MM-dd")))
    told = gaps.withColumn("label", label).groupBy("station_id", "code", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_day", "label"))), lambda x: x["label"]), "、").alias("labels"))  # of one month
    texts = told.groupBy("station_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", F.concat("name", F.lit("："), "labels").alias("t")))), lambda x: x["t"]), "；").alias("texts"))
    missing = F.when(~F.coalesce("enabled", F.lit(False)), DISABLED).when(F.col("set") == 0, NOT_SET).when(F.col("valid") == 0, WHOLE_MONTH).otherwise(F.coalesce("texts", F.lit(NOTHING_MISSING)))
    return totals.join(texts, "station_id", "left").select("station_id", "valid", "expected", missing.alias("missing"))


def valid_station_rate(monthly: DataFrame, stations: DataFrame) -> DataFrame:
    """stations, enabled, valid, rate: how many stations sent anything, in percent of all that are configured."""
    both = stations.select("station_id", "enabled").join(monthly.select("station_id", "valid"), "station_id", "left")
    counts = both.agg(F.count("*").alias("stations"), F.count_if("enabled").alias("enabled"), F.count_if(F.col("enabled") & (F.col("valid") > 0)).alias("valid"))
    return counts.withColumn("rate", percent(F.col("valid"), F.col("stations")))


def subset_distribution(graded: DataFrame, stations: DataFrame, keep: Column) -> DataFrame:
    """Grades of the stations that `keep` (water type, tributary, station type) holds for."""
    return distribution(graded.join(stations.filter(keep).select("station_id"), "station_id", "left_semi"))


def _stations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("station_id")).distinct().select("station_id", (F.col("station_id") % 7 > 0).alias("enabled"), F.when(F.col("station_id") % 3 > 0, "Ⅰ").alias("target"), F.when(F.col("station_id") % 5 == 0, "lake").otherwise("river").alias("water_type"))


def _indicators(s: SparkSession, d: str) -> DataFrame:
    both = F.array(F.struct(F.lit(0).alias("code"), F.lit("pH").alias("name"), F.lit(12).alias("hours")), F.struct(F.lit(1).alias("code"), F.lit("DO").alias("name"), F.lit(24).alias("hours")))
    return _stations(s, d).filter("station_id % 11 > 0").select("station_id", F.inline(both))


def _readings(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("user_id").alias("station_id"), "event_id", F.col("ts").cast("timestamp").alias("t"), F.when(F.col("user_id") % 2 == 0, F.lit(1.0)).otherwise(F.col("value")).alias("value"))
    half = e.groupBy("station_id", F.window("t", "12 hours")["start"].alias("slot")).agg(F.max_by("value", "event_id").alias("value")).select("station_id", F.lit(0).alias("code"), "slot", "value")
    return half.unionByName(half.filter(F.hour("slot") == 0).withColumn("code", F.lit(1)))


_day = lambda x: F.lit(x).cast("date")
_READ = """WITH e AS (SELECT user_id AS st, event_id, time_bucket(INTERVAL 12 HOUR, ts) AS slot, CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE value END AS value FROM events), h AS (SELECT st, slot, arg_max(value, event_id) AS v FROM e GROUP BY 1, 2),
f AS (SELECT st, 0 AS code, slot, v FROM h UNION ALL SELECT st, 1, slot, v FROM h WHERE hour(slot) = 0), s AS (SELECT DISTINCT user_id AS st FROM events)
"""
register("W13_daily_table", lambda s, d: daily_table(_stations(s, d), _indicators(s, d), _readings(s, d), _day("2024-01-20"), 3).withColumn("recent", F.array_join("recent", "|")), _READ + """
, p AS (SELECT st, day, max(v) FILTER (code = 0 AND hour(slot) = 0) AS a, max(v) FILTER (code = 0 AND hour(slot) = 12) AS b FROM (SELECT st, CAST(t.day AS DATE) AS day FROM s, generate_series(TIMESTAMP '2024-01-18', TIMESTAMP '2024-01-20', INTERVAL 1 DAY) AS t(day)) LEFT JOIN (SELECT f.st AS fst, * EXCLUDE (st) FROM f) ON fst = st AND CAST(slot AS DATE) = day GROUP BY 1, 2),
q AS (SELECT st, day, a, b, CASE WHEN st % 11 = 0 THEN '待配置' WHEN a IS NULL AND b IS NULL THEN '未监测' WHEN a IS NULL THEN 'pH（00时缺测）、DO（00时缺测）' WHEN b IS NULL THEN 'pH（12时缺测）' WHEN a = b THEN 'pH（恒值）' ELSE '正常' END AS x FROM p),
r AS (SELECT st, max(x) FILTER (day = DATE '2024-01-20') AS today, max(x) FILTER (day = DATE '2024-01-19') AS yesterday, string_agg(x, '|' ORDER BY day) AS recent, max(CASE WHEN a IS NULL THEN 0 ELSE 2 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END) FILTER (day = DATE '2024-01-20') AS valid FROM q GROUP BY st)
SELECT st AS station_id, CASE WHEN st % 7 = 0 THEN '未启用' ELSE today END AS today, CASE WHEN st % 7 = 0 THEN '未启用' ELSE yesterday END AS yesterday, CASE WHEN st % 7 = 0 THEN '未启用|未启用|未启用' ELSE recent END AS recent,
  CAST(CASE WHEN st % 7 = 0 OR st % 11 = 0 THEN 0 ELSE valid END AS BIGINT) AS valid, CAST(CASE WHEN st % 7 = 0 OR st % 11 = 0 THEN 0 ELSE 3 END AS BIGINT) AS expected FROM r""")


def _hourly(s: SparkSession, d: str) -> DataFrame:
    """Grades for every hour of some stations: a day's grade holds for each of its hours."""
    return _daily(s, d).select("station_id", "grade", F.explode(F.sequence(F.col("day").cast("timestamp"), F.col("day").cast("timestamp") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))).alias("slot"))


register("W16_conditions", lambda s, d: conditions(_stations(s, d), _hourly(s, d), _daily(s, d), _day("2024-01-20")), _GRADED + """
, s AS (SELECT DISTINCT station_id FROM g), c AS (SELECT s.station_id, count(*) FILTER (o_ > 1 AND day > DATE '2024-01-15') AS h, count(*) FILTER (o_ > 1 AND day > DATE '2024-01-13') AS d, count(*) FILTER (o_ > 4 AND day > DATE '2024-01-17') AS w, count(*) FILTER (o_ = 6 AND day = DATE '2024-01-20') AS i
  FROM s LEFT JOIN daily ON s.station_id = daily.station_id AND day <= DATE '2024-01-20' GROUP BY 1)
SELECT station_id, CASE WHEN station_id % 3 > 0 THEN h = 5 END AS hours_over, CASE WHEN station_id % 3 > 0 THEN d = 7 END AS days_over, w = 3 AS days_worse, i = 1 AS inferior FROM c""")
_month = lambda: F.sequence(_day("2024-01-01"), _day("2024-01-10"))
_counts = lambda s, d: _graded(s, d).groupBy("station_id", "day", (F.col("id") % 2).cast("int").alias("code")).agg(F.count("*").alias("n"))
_MONTH = _GRADED + """
, c AS (SELECT station_id, day, id % 2 AS code, count(*) AS n FROM g GROUP BY 1, 2, 3), k AS (SELECT s.station_id AS st, s.day AS dy, v.code AS cd, coalesce(c.n, 0) AS n, CASE v.code WHEN 0 THEN 2 ELSE 1 END AS each FROM spine s CROSS JOIN (VALUES (0), (1)) AS v(code)
  LEFT JOIN c ON c.station_id = s.station_id AND c.day = s.day AND c.code = v.code WHERE s.day <= DATE '2024-01-10' AND s.station_id % 11 > 0)
, m AS (SELECT st, cd, dy, dy - CAST(row_number() OVER (PARTITION BY st, cd ORDER BY dy) AS INTEGER) AS i FROM k WHERE n < each), r AS (SELECT st, cd, min(dy) AS a, max(dy) AS b FROM m GROUP BY st, cd, i)
, l AS (SELECT st, cd, string_agg(CASE WHEN a = b THEN strftime(a, '%m-%d') ELSE strftime(a, '%m-%d') || '~' || strftime(b, '%m-%d') END, '、' ORDER BY a) AS x FROM r GROUP BY 1, 2), t AS (SELECT st, string_agg(CASE cd WHEN 0 THEN 'pH：' ELSE 'DO：' END || x, '；' ORDER BY cd) AS x FROM l GROUP BY 1)
, v AS (SELECT station_id, coalesce(valid, 0) AS valid, coalesce(expected, 0) AS expected, x FROM (SELECT DISTINCT station_id FROM g) LEFT JOIN (SELECT st, sum(least(n, each)) AS valid, sum(each) AS expected FROM k GROUP BY st) ON st = station_id LEFT JOIN (SELECT st AS s2, x FROM t) ON s2 = station_id)
"""
register("W19_month_by_indicator", lambda s, d: monthly_completeness(_stations(s, d), _indicators(s, d), _counts(s, d), _month()), _MONTH + """
SELECT station_id, CAST(valid AS BIGINT) AS valid, CAST(expected AS BIGINT) AS expected, CASE WHEN station_id % 7 = 0 THEN '未启用' WHEN station_id % 11 = 0 THEN '待配置' WHEN valid = 0 THEN '整月未监测' ELSE coalesce(x, '无') END AS missing FROM v""")
register("W19_valid_stations", lambda s, d: valid_station_rate(monthly_completeness(_stations(s, d), _indicators(s, d), _counts(s, d), _month()), _stations(s, d)), _MONTH + """
SELECT count(*) AS stations, count(*) FILTER (station_id % 7 > 0) AS enabled, count(*) FILTER (station_id % 7 > 0 AND valid > 0) AS valid, round_even(100.0::DOUBLE * count(*) FILTER (station_id % 7 > 0 AND valid > 0) / count(*), 2) AS rate FROM v""")
register("W18_lake_grades", lambda s, d: subset_distribution(_daily(s, d), _stations(s, d), F.col("water_type") == "lake").select("grade", "n"),
         _GRADED + "SELECT v.g AS grade, count(x.grade_) AS n FROM (VALUES ('Ⅰ'), ('Ⅱ'), ('Ⅲ'), ('Ⅳ'), ('Ⅴ'), ('劣Ⅴ')) AS v(g) LEFT JOIN daily x ON x.grade_ = v.g AND x.station_id % 5 = 0 GROUP BY v.g")


def _repository(s: SparkSession, d: str) -> StationRepository:
    """Events as hourly readings, spread over six months; a twentieth is marked as deleted."""
    own, k = StationRepository(s, f"{shared_folder(s)}/sparkloom-stations/{uuid.uuid4().hex}"), F.col("event_id")
    time = F.col("ts").cast("timestamp") + F.make_interval(months=(k % 6).cast("int"))
    own.write("hourly", table(s, d, "events").select(k.alias("id"), F.col("user_id").alias("station_id"), time.alias("monitor_time"), F.lit("ok").alias("status"), F.element_at(F.array(*map(F.lit, GRADES)), (k % 6 + 1).cast("int")).alias("water_quality_level"),
                                                     F.when(k % 20 == 0, "1").otherwise("0").alias("del_flag"), F.col("value").alias("m1_value"), F.lit(0.0).alias("m2_value")))
    return own


def _period_readings(s: SparkSession, d: str) -> DataFrame:
    spans = "VALUES ('spring', TIMESTAMP'2024-03-10', TIMESTAMP'2024-05-05 12:00:00'), ('june', TIMESTAMP'2024-06-01', TIMESTAMP'2024-06-08') AS t(period, start, end)"
    found = _repository(s, d).readings_of("hourly", s.sql(f"SELECT * FROM {spans}"), [0])
    return found.groupBy("period", "station_id", "water_quality_level").agg(F.count("*").alias("n"), F.max("m1_value").alias("most"), F.min("id").alias("first"))


register("S14_period_readings", _period_readings, f"""
WITH h AS (SELECT event_id AS id, user_id AS station_id, ts + to_months(CAST(event_id % 6 AS INTEGER)) AS t, {list(GRADES)}[event_id % 6 + 1] AS water_quality_level, value FROM events WHERE event_id % 20 <> 0),
p AS (SELECT * FROM (VALUES ('spring', TIMESTAMP '2024-03-10', TIMESTAMP '2024-05-05 12:00:00'), ('june', TIMESTAMP '2024-06-01', TIMESTAMP '2024-06-08')) AS t(period, a, b))
SELECT period, station_id, water_quality_level, count(*) AS n, max(value) AS most, min(id) AS first FROM h JOIN p ON t >= a AND t < b GROUP BY 1, 2, 3""")
