"""Monitoring reports over station readings: grades, slots, gaps, episodes, completeness.

Facts are rows of (station, time, grade or value). Missing slots are made visible by a spine of expected slots, one row
per station and slot, so every rule is a join, a group or a window partitioned by station.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import percent
from ..registry import register
from ..sources.tables import table

#: Grades from best to worst.
GRADES = ("Ⅰ", "Ⅱ", "Ⅲ", "Ⅳ", "Ⅴ", "劣Ⅴ")
#: Other spellings of grades.
ALIASES = {"I": "Ⅰ", "II": "Ⅱ", "III": "Ⅲ", "IV": "Ⅳ", "V": "Ⅴ", "劣V": "劣Ⅴ"}
#: What a comparison of two grades says.
SAME, BETTER, WORSE, NO_DATA = "持平", "有所好转", "有所下降", "无有效数据"
SLOT_HOURS_OF_A_MONTH = 28 * 24


def normal_grade(value: Column) -> Column:
    """A grade's own spelling; null for anything else, lower case too."""
    text = F.trim(F.replace(F.trim(value.cast("string")), F.lit("类"), F.lit("")))
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    text = F.coalesce(F.try_element_at(aliases, text), text)
    return F.when(text.isin(*GRADES), text)


def ordinal(grade: Column) -> Column:
    """1 for the best grade, up to 6."""
    found = F.array_position(F.array(*[F.lit(g) for g in GRADES]), normal_grade(grade)).cast("int")
    return F.when(found > 0, found)


def compare(now: Column, before: Column) -> Column:
    """Whether a grade stayed, got better or worse; or that one of them is not known."""
    a, b = ordinal(now), ordinal(before)
    return F.when(a.isNull() | b.isNull(), NO_DATA).when(a == b, SAME).when(a < b, BETTER).otherwise(WORSE)


def frequencies(stations: DataFrame, config: str = "monitor_frequency") -> DataFrame:
    """A row per station and configured indicator: station_id, code, name, hours, reading (the column of its readings).

    Entries without a code, a name or a frequency that can be read are left out; so is text that is no JSON list.
    """
    shape = "array<struct<indicatorCode:string,indicatorName:string,frequency:string,frequencySuffix:string>>"
    items = stations.select("station_id", F.explode(F.from_json(config, shape)).alias("i"))
    text = F.concat_ws(" ", "i.frequency", "i.frequencySuffix")
    number, hours, days = F.col("i.frequency").try_cast("double"), F.regexp_extract(text, r"(\d+)\s*小时", 1).try_cast("int"), F.regexp_extract(text, r"(\d+)\s*天", 1).try_cast("int")
    every = F.when(number > 0, F.floor(number)).when(hours.isNotNull(), F.greatest(hours, F.lit(1))).when(days.isNotNull(), F.greatest(days, F.lit(1)) * 24).when(text.contains("月"), 24 * 31)
    rows = items.select("station_id", F.col("i.indicatorCode").try_cast("int").alias("code"), F.trim("i.indicatorName").alias("name"), every.cast("int").alias("hours"))
    return rows.filter("code IS NOT NULL AND name <> '' AND hours IS NOT NULL").withColumn("reading", F.format_string("m%d_value", F.col("code") + 1))


def slots(start: Column, end: Column, hours: Column) -> Column:
    """Expected times from start until before end; one for a month's frequency, none without a positive one."""
    step = F.make_interval(hours=F.when(hours > 0, hours).otherwise(1))
    whole = F.filter(F.sequence(start, F.greatest(start, end), step), lambda t: t < end)
    return F.when((hours <= 0) | (end <= start), F.array().cast("array<timestamp>")).when(hours >= SLOT_HOURS_OF_A_MONTH, F.array(start)).otherwise(whole)


def completeness(expected: DataFrame, facts: DataFrame) -> DataFrame:
    """Per station and indicator: expected, valid, missing slots, and whether at least two readings are all the same.

    expected: station_id, code, slot. facts: station_id, code, slot, value.
    """
    joined = expected.join(facts, ["station_id", "code", "slot"], "left")
    got = joined.groupBy("station_id", "code").agg(F.count("*").alias("expected"), F.count("value").alias("valid"), F.count_distinct("value").alias("kinds"))
    return got.select("station_id", "code", "expected", "valid", (F.col("expected") - F.col("valid")).alias("missing"), ((F.col("expected") == F.col("valid")) & (F.col("valid") >= 2) & (F.col("kinds") == 1)).alias("constant"))


def islands(rows: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """rows with `island`, alike for neighbours whose `place` (a whole number) goes up by one."""
    return rows.withColumn("island", place - F.row_number().over(Window.partitionBy(*keys).orderBy(place)))


def ranges(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """First and last day of every run of consecutive days, by keys."""
    distinct = days.select(*keys, day).distinct()
    return islands(distinct, keys, F.unix_date(day)).groupBy(*keys, "island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days")).drop("island")


def missing_runs(missing: DataFrame, keys: list[str], time: str, hours: int) -> DataFrame:
    """Runs of missing times an interval apart, as first, last and a label like 03-05."""
    place = F.floor(F.unix_timestamp(time) / (3600 * hours))
    runs = islands(missing.select(*keys, time).distinct(), keys, place).groupBy(*keys, "island").agg(F.min(time).alias("first"), F.max(time).alias("last"))
    a, b = F.date_format("first", "HH"), F.date_format("last", "HH")
    return runs.select(*keys, "first", "last", F.when(F.col("first") == F.col("last"), a).otherwise(F.concat(a, F.lit("-"), b)).alias("label"))


def episodes(spine: DataFrame, keys: list[str], day: str, matched: str, run: int, start: Column, end: Column) -> DataFrame:
    """How many runs of matched days reach `run` days within [start, end), by keys. Days before count into a run."""
    hits = islands(spine.filter(F.col(matched)), keys, F.unix_date(day))
    nth = hits.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "island").orderBy(day)))
    counted = nth.filter((F.col("_n") == run) & (F.col(day) >= start) & (F.col(day) < end)).groupBy(*keys).agg(F.count("*").alias("episodes"))
    return spine.select(*keys).distinct().join(counted, keys, "left").select(*keys, F.coalesce("episodes", F.lit(0)).cast("long").alias("episodes"))


def latest(facts: DataFrame, keys: list[str], time: str, tie: str, value: str) -> DataFrame:
    """The value of the latest row by keys; of equal times the later in `tie`. A null one stays null."""
    return facts.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(time, tie)).alias("_l")).select(*keys, F.col("_l.v").alias(value))


def resolve_targets(targets: DataFrame, month: int) -> DataFrame:
    """Each section's target grade: the month's own before the year's (month 0), the later row of equals; grades that are
    not known don't count."""
    known = targets.withColumn("grade", normal_grade(F.col("grade"))).filter(F.col("grade").isNotNull() & F.col("month").isin(0, month))
    return known.groupBy("section_id").agg(F.max_by("grade", F.struct("month", "id")).alias("grade"))


def distribution(graded: DataFrame, grade: str = "grade") -> DataFrame:
    """Every grade with its number and share in percent, those without a row too."""
    spark = graded.sparkSession
    all_grades = spark.range(1).select(F.posexplode(F.array(*[F.lit(g) for g in GRADES])).alias("i", "g"))
    counts = graded.groupBy(F.col(grade).alias("g")).agg(F.count("*").alias("n"))
    total = graded.filter(F.col(grade).isNotNull()).agg(F.count("*").alias("total"))
    return all_grades.join(counts, "g", "left").join(F.broadcast(total)).select(F.col("g").alias("grade"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), percent(F.coalesce("n", F.lit(0)), F.col("total")).alias("share"))


# --- bindings to the events table: a user is a station, a value's band is its grade


def _graded(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    band = F.floor(F.least(F.col("value"), F.lit(119.0)) / 20).cast("int")
    spelling = F.element_at(F.array(*[F.lit(g) for g in ("I", "Ⅱ类", "III", " Ⅳ", "v", "劣V类")]), band + 1)
    return e.select(F.col("user_id").alias("station_id"), F.col("event_id").alias("id"), F.col("ts").alias("time"), F.to_date("ts").alias("day"), spelling.alias("raw"), "value")


_GRADED = """WITH g AS (
  SELECT user_id AS station_id, event_id AS id, ts AS time, CAST(ts AS DATE) AS day, value, CAST(floor(least(value, 119.0) / 20) AS INTEGER) AS band FROM events
), graded AS (SELECT *, CASE band WHEN 0 THEN 'Ⅰ' WHEN 1 THEN 'Ⅱ' WHEN 2 THEN 'Ⅲ' WHEN 3 THEN 'Ⅳ' WHEN 5 THEN '劣Ⅴ' END AS grade, CASE WHEN band <> 4 THEN band + 1 END AS o FROM g),
daily AS (SELECT station_id, day, arg_max(coalesce(grade, ''), id) AS grade_, arg_max(coalesce(o, 0), id) AS o_ FROM graded GROUP BY station_id, day),
spine AS (SELECT s.station_id, CAST(t.day AS DATE) AS day FROM (SELECT DISTINCT station_id FROM g) s, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) AS t(day))
"""


def _daily(s, d):
    return latest(_graded(s, d).withColumn("grade", normal_grade(F.col("raw"))), ["station_id", "day"], "time", "id", "grade")


def _spine(s, d, hours: int = 24):
    stations = table(s, d, "events").select(F.col("user_id").alias("station_id")).distinct()
    stamp = lambda x: F.lit(x).cast("timestamp")
    return stations.select("station_id", F.explode(slots(stamp("2024-01-01"), stamp("2024-01-31"), F.lit(hours))).alias("slot"))


def _day_spine(s, d):
    return _spine(s, d).select("station_id", F.to_date("slot").alias("day"))


register("W1_normal_grade", lambda s, d: _graded(s, d).select("id", normal_grade(F.col("raw")).alias("grade")), _GRADED + "SELECT id, grade FROM graded")
register("W2_compare", lambda s, d: _daily(s, d).alias("a").join(_daily(s, d).select("station_id", F.date_add("day", 1).alias("day"), F.col("grade").alias("before")), ["station_id", "day"]).select("station_id", "day", compare(F.col("grade"), F.col("before")).alias("said")),
         _GRADED + f"SELECT a.station_id, a.day, CASE WHEN a.o_ = 0 OR b.o_ = 0 THEN '{NO_DATA}' WHEN a.o_ = b.o_ THEN '{SAME}' WHEN a.o_ < b.o_ THEN '{BETTER}' ELSE '{WORSE}' END AS said FROM daily a JOIN daily b ON a.station_id = b.station_id AND b.day = a.day - 1")


def _configured(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    item = lambda code, name, often, suffix: F.struct(code.alias("indicatorCode"), F.lit(name).alias("indicatorName"), often.alias("frequency"), suffix.alias("frequencySuffix"))
    hours = F.when(k % 3 == 0, F.lit("4")).otherwise(F.lit(None).cast("string"))
    suffix = F.when(k % 3 == 0, "").when(k % 3 == 1, "2天1次").otherwise("每月1次")
    both = F.array(item(k.cast("string"), "pH", hours, suffix), item(F.lit("x"), "bad", F.lit("1"), F.lit("")))
    return frequencies(table(s, d, "events").select(F.col("event_id").alias("station_id"), F.to_json(both).alias("monitor_frequency")))


_CONFIGURED = "WITH c AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) "
register("W3_frequencies", _configured, _CONFIGURED + "SELECT event_id AS station_id, k AS code, 'pH' AS name, CASE k % 3 WHEN 0 THEN 4 WHEN 1 THEN 48 ELSE 744 END AS hours, concat('m', k + 1, '_value') AS reading FROM c")
_FREQUENCIES = (-1, 0, 1, 4, 5, 24, 700)


def _slotted(s: SparkSession, d: str) -> DataFrame:
    """An order's expected times from its day on, for some hours, at one of seven frequencies."""
    start, hours = F.col("o_orderdate").cast("timestamp"), F.element_at(F.array(*map(F.lit, _FREQUENCIES)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    own = slots(start, start + F.make_interval(hours=(F.col("o_custkey") % 40).cast("int")), hours)
    return table(s, d, "orders").select("o_orderkey", F.size(own).alias("n"), (F.unix_timestamp(F.element_at(F.when(F.size(own) > 0, own), -1)) - F.unix_timestamp(start)).alias("last"))


register("W4_slots", _slotted, f"""
WITH o AS (SELECT o_orderkey, o_custkey % 40 AS len, {list(_FREQUENCIES)}[o_orderkey % 7 + 1] AS h FROM orders),
n AS (SELECT *, CASE WHEN h <= 0 OR len = 0 THEN 0 WHEN h >= 672 THEN 1 ELSE ceil(len / h::DOUBLE) END AS n FROM o)
SELECT o_orderkey, CAST(n AS INTEGER) AS n, CASE WHEN n > 0 THEN CAST((n - 1) * h * 3600 AS BIGINT) END AS last FROM n""")


def _complete(s, d):
    expected = _spine(s, d, 4).withColumn("code", F.lit(0))
    facts = table(s, d, "events").select(F.col("user_id").alias("station_id"), F.window(F.col("ts").cast("timestamp"), "4 hours")["start"].alias("slot"), "value", "event_id").groupBy("station_id", "slot").agg(F.max_by("value", "event_id").alias("value")).withColumn("code", F.lit(0))
    return completeness(expected, facts)


register("W5_completeness", _complete, """
WITH f AS (SELECT user_id AS station_id, time_bucket(INTERVAL 4 HOUR, ts) AS slot, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2),
e AS (SELECT s.station_id, t.slot FROM (SELECT DISTINCT station_id FROM f) s, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 20:00:00', INTERVAL 4 HOUR) AS t(slot))
SELECT e.station_id, 0 AS code, count(*) AS expected, count(value) AS valid, count(*) - count(value) AS missing, count(*) = count(value) AND count(value) >= 2 AND count(DISTINCT value) = 1 AS constant
FROM e LEFT JOIN f ON e.station_id = f.station_id AND e.slot = f.slot GROUP BY 1
""")


def _runs(s, d):
    hours = table(s, d, "events").select(F.col("user_id").alias("station_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("slot")).distinct()
    missing = _spine(s, d, 1).join(hours, ["station_id", "slot"], "left_anti").withColumn("day", F.to_date("slot"))
    return missing_runs(missing, ["station_id", "day"], "slot", 1).select("station_id", F.col("first").cast("string").alias("first"), "label")


register("W6_missing_runs", _runs, """
WITH h AS (SELECT DISTINCT user_id AS station_id, date_trunc('hour', ts) AS slot FROM events),
m AS (SELECT s.station_id, t.slot FROM (SELECT DISTINCT user_id AS station_id FROM events) s, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR) AS t(slot)
  EXCEPT SELECT * FROM h),
i AS (SELECT *, CAST(epoch(slot) / 3600 AS BIGINT) - row_number() OVER (PARTITION BY station_id, CAST(slot AS DATE) ORDER BY slot) AS g FROM m)
SELECT station_id, strftime(min(slot), '%Y-%m-%d %H:%M:%S') AS first, CASE WHEN count(*) = 1 THEN strftime(min(slot), '%H') ELSE concat(strftime(min(slot), '%H'), '-', strftime(max(slot), '%H')) END AS label FROM i GROUP BY station_id, CAST(slot AS DATE), g
""")
_PRESENT = ", present AS (SELECT DISTINCT station_id, day FROM g), missing AS (SELECT s.* FROM spine s ANTI JOIN present p ON s.station_id = p.station_id AND s.day = p.day) "
register("W7_missing_days", lambda s, d: ranges(_day_spine(s, d).join(_graded(s, d).select("station_id", "day").distinct(), ["station_id", "day"], "left_anti"), ["station_id"], "day"),
         _GRADED + _PRESENT + "SELECT station_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY station_id ORDER BY day) AS INTEGER) AS k FROM missing) GROUP BY station_id, k")


def _worse(s, d):
    return _day_spine(s, d).join(_daily(s, d), ["station_id", "day"], "left").withColumn("hit", F.coalesce(ordinal(F.col("grade")) >= 2, F.lit(False)))


register("W8_episodes", lambda s, d: episodes(_worse(s, d), ["station_id"], "day", "hit", 3, F.lit("2024-01-08").cast("date"), F.lit("2024-01-31").cast("date")), _GRADED + """
, hit AS (SELECT station_id, day, day - CAST(row_number() OVER (PARTITION BY station_id ORDER BY day) AS INTEGER) AS k FROM daily WHERE o_ >= 2),
nth AS (SELECT *, row_number() OVER (PARTITION BY station_id, k ORDER BY day) AS n FROM hit)
SELECT s.station_id, count(n.day) AS episodes FROM (SELECT DISTINCT station_id FROM g) s LEFT JOIN nth n ON s.station_id = n.station_id AND n = 3 AND n.day >= DATE '2024-01-08' AND n.day < DATE '2024-01-31' GROUP BY 1
""")
register("W9_percent", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") != "P").alias("n")).select("o_custkey", F.round(percent(F.col("f"), F.col("n")), 1).alias("share")),
         "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') > 0 THEN round(round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus <> 'P'), 2), 1) END AS share FROM orders GROUP BY 1")
register("W10_latest_grade", _daily, _GRADED + "SELECT station_id, day, nullif(grade_, '') AS grade FROM daily")
register("W11_hourly_grade", lambda s, d: latest(_graded(s, d).withColumn("grade", normal_grade(F.col("raw"))).withColumn("hour", F.date_trunc("hour", "time").cast("string")), ["station_id", "hour"], "time", "id", "grade"),
         _GRADED + "SELECT station_id, strftime(date_trunc('hour', time), '%Y-%m-%d %H:%M:%S') AS hour, nullif(arg_max(coalesce(grade, ''), id), '') AS grade FROM graded GROUP BY 1, 2")


def _targets(s, d):
    rows = _graded(s, d).select("id", F.col("station_id").alias("section_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.month("day")).alias("month"), F.col("raw").alias("grade"))
    return resolve_targets(rows, 1)


register("W12_targets", _targets, _GRADED + "SELECT station_id AS section_id, arg_max(grade, (CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END) * 100000000 + id) AS grade FROM graded WHERE grade IS NOT NULL GROUP BY 1")
register("W14_distribution", lambda s, d: distribution(_daily(s, d)),
         _GRADED + ", t AS (SELECT count(*) AS total FROM daily WHERE grade_ <> '') SELECT v.g AS grade, count(x.grade_) AS n, CASE WHEN any_value(total) > 0 THEN round_even(100.0::DOUBLE * count(x.grade_) / any_value(total), 2) END AS share FROM (VALUES ('Ⅰ'), ('Ⅱ'), ('Ⅲ'), ('Ⅳ'), ('Ⅴ'), ('劣Ⅴ')) AS v(g) CROSS JOIN t LEFT JOIN daily x ON x.grade_ = v.g GROUP BY v.g")


def _lists(s, d):
    said = _daily(s, d).join(_daily(s, d).select("station_id", F.date_add("day", 1).alias("day"), F.col("grade").alias("before")), ["station_id", "day"])
    said = said.withColumn("said", compare(F.col("grade"), F.col("before")))
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.format_string("%05d", "station_id")))), ",")  # noqa: E731  a report's stations
    return said.groupBy("day").agg(names(F.col("said") == BETTER).alias("improved"), names(F.col("said") == WORSE).alias("declined"), names(ordinal(F.col("grade")) > 3).alias("poor"))


register("W15_change_lists", _lists, _GRADED + """
, p AS (SELECT a.station_id, a.day, a.o_ AS now, b.o_ AS before FROM daily a JOIN daily b ON a.station_id = b.station_id AND b.day = a.day - 1)
SELECT day, coalesce(string_agg(printf('%05d', station_id), ',' ORDER BY station_id) FILTER (now > 0 AND before > 0 AND now < before), '') AS improved,
       coalesce(string_agg(printf('%05d', station_id), ',' ORDER BY station_id) FILTER (now > 0 AND before > 0 AND now > before), '') AS declined,
       coalesce(string_agg(printf('%05d', station_id), ',' ORDER BY station_id) FILTER (now > 3), '') AS poor FROM p GROUP BY day
""")


def continuous(spine: DataFrame, keys: list[str], day: str, hit: str, days: int) -> DataFrame:
    """keys and days on which a condition has held for `days` days in a row; a missing day breaks it."""
    last = Window.partitionBy(*keys).orderBy(day).rowsBetween(1 - days, 0)
    return spine.withColumn("_held", F.sum(F.col(hit).cast("int")).over(last)).filter(F.col("_held") == days).select(*keys, day)


register("W16_continuous", lambda s, d: continuous(_worse(s, d), ["station_id"], "day", "hit", 3), _GRADED + """
, h AS (SELECT s.station_id, s.day, coalesce(d.o_ >= 2, false) AS hit FROM spine s LEFT JOIN daily d ON s.station_id = d.station_id AND s.day = d.day),
w AS (SELECT *, sum(CAST(hit AS INTEGER)) OVER (PARTITION BY station_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM h)
SELECT station_id, day FROM w WHERE n = 3
""")
register("W17_declined_by_two", lambda s, d: _daily(s, d).join(_daily(s, d).select("station_id", F.date_add("day", 1).alias("day"), F.col("grade").alias("before")), ["station_id", "day"]).filter(ordinal(F.col("grade")) - ordinal(F.col("before")) >= 2).select("station_id", "day"),
         _GRADED + "SELECT a.station_id, a.day FROM daily a JOIN daily b ON a.station_id = b.station_id AND b.day = a.day - 1 WHERE a.o_ > 0 AND b.o_ > 0 AND a.o_ - b.o_ >= 2")
register("W18_subsets", lambda s, d: distribution(_daily(s, d).filter("station_id % 5 = 0")).select("grade", "n"),
         _GRADED + "SELECT v.g AS grade, count(x.grade_) AS n FROM (VALUES ('Ⅰ'), ('Ⅱ'), ('Ⅲ'), ('Ⅳ'), ('Ⅴ'), ('劣Ⅴ')) AS v(g) LEFT JOIN daily x ON x.grade_ = v.g AND x.station_id % 5 = 0 GROUP BY v.g")


def _monthly(s, d):
    counts = _graded(s, d).groupBy("station_id", "day").agg(F.count("*").alias("n"))
    joined = _day_spine(s, d).join(counts, ["station_id", "day"], "left")
    got = joined.groupBy("station_id").agg(F.sum(F.least(F.coalesce("n", F.lit(0)), F.lit(2))).alias("valid"), (F.count("*") * 2).alias("expected"), F.count_if(F.col("n").isNull()).alias("missing_days"))
    return got.withColumn("rate", percent(F.col("valid"), F.col("expected")))


register("W19_monthly_completeness", _monthly, _GRADED + """
, c AS (SELECT station_id, day, count(*) AS n FROM g GROUP BY 1, 2)
SELECT s.station_id, CAST(sum(least(coalesce(n, 0), 2)) AS BIGINT) AS valid, count(*) * 2 AS expected, count(*) FILTER (n IS NULL) AS missing_days,
       round_even(100.0::DOUBLE * sum(least(coalesce(n, 0), 2)) / (count(*) * 2), 2) AS rate FROM spine s LEFT JOIN c ON s.station_id = c.station_id AND s.day = c.day GROUP BY 1
""")
register("W20_monthly_episodes", lambda s, d: episodes(_worse(s, d), ["station_id"], "day", "hit", 5, F.lit("2024-01-07").cast("date"), F.lit("2024-01-31").cast("date")), _GRADED + """
, hit AS (SELECT station_id, day, day - CAST(row_number() OVER (PARTITION BY station_id ORDER BY day) AS INTEGER) AS k FROM daily WHERE o_ >= 2),
nth AS (SELECT *, row_number() OVER (PARTITION BY station_id, k ORDER BY day) AS n FROM hit)
SELECT s.station_id, count(n.day) AS episodes FROM (SELECT DISTINCT station_id FROM g) s LEFT JOIN nth n ON s.station_id = n.station_id AND n = 5 AND n.day >= DATE '2024-01-07' AND n.day < DATE '2024-01-31' GROUP BY 1
""")
register("W21_indicator_options", lambda s, d: _configured(s, d).groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("hours")), ",").alias("hours")),
         _CONFIGURED + "SELECT k AS code, CAST(CASE k % 3 WHEN 0 THEN 4 WHEN 1 THEN 48 ELSE 744 END AS VARCHAR) AS hours FROM c GROUP BY k")
register("W25_narrative", lambda s, d: distribution(_daily(s, d)).select("grade", F.format_string("%s: %d", "grade", "n").alias("sentence")),
         _GRADED + "SELECT v.g AS grade, concat(v.g, ': ', count(x.grade_)) AS sentence FROM (VALUES ('Ⅰ'), ('Ⅱ'), ('Ⅲ'), ('Ⅳ'), ('Ⅴ'), ('劣Ⅴ')) AS v(g) LEFT JOIN daily x ON x.grade_ = v.g GROUP BY v.g")
