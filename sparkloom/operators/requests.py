"""Requests in words: reports and charts that a message asks for, indicators it names, date ranges of SQL, and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import register
from ..sources.tables import table

#: Words that ask for a report to be made.
MAKE = "生成|导出|制作|出一份|给我|创建"
#: Days that a daily report may look back, and what it does by default.
FEWEST_DAYS, MOST_DAYS, DAYS = 2, 7, 3
#: Forms that name indicators, what they are parted by, and other names of some.
NAMED = ("(?:只看|仅看|只要|指标为|关注)(.+?)(?=近\\d+日|\\d+小时|[。；;]|$)", "查看(.+?)指标")
_PARTS, _ENDS = "[，,、和及与]+", "，,、和及与的"
ALIASES = {"ph值": "ph", "高锰酸盐": "高锰酸盐指数", "codmn": "高锰酸盐指数", "叶绿素": "叶绿素a"}
#: Words for types of charts; the first that is found counts.
CHARTS = (
    ("组合图|柱线图|柱状折线图|双轴图|柱状图和折线图", "combo"), ("雷达图", "radar"), ("热力图", "heatmap"), ("箱线图|箱形图|盒须图", "boxplot"), ("仪表盘|仪表图", "gauge"), ("横向柱状图|横向条形图", "horizontal_bar"),
    ("柱状图|柱形图|直方图", "bar"), ("面积图", "area"), ("折线图|线形图|曲线图", "line"), ("环形图|甜甜圈图", "donut"), ("饼图|扇形图|圆饼", "pie"), ("气泡图", "bubble"), ("散点图", "scatter"),
)
#: How a message begins that switches a chart, what it ends with after 用, and how one begins that adds a chart.
SWITCH = "改成|切换为|切换成|换成|变成|变为|转为|转成|展示为|显示为|改为"
SHOWN = "显示|展示|呈现|画|出图"
APPEND = "加个|加一个|加一张|再加个|再加一个|再加一张|补充个|补充一个|补充一张|再生成个|再生成一个|再生成一张|新增个|新增一个|新增一张"
#: Headers of columns that number rows.
ROW_NUMBER = r"(?i)^(#|排名|序号|序|No\.?|编号|行号|row|num|index)$"


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def report_intent(message: Column, today: Column) -> Column:
    """The report that a message asks to make, or null: type, period (day, or first of the month), recent_days, hours (of
    one measurement, or null), selectable (no type was named), error (or null)."""
    m = _plain(message)
    daily, monthly = F.contains(m, F.lit("日报")), F.contains(m, F.lit("月报"))
    generic = F.contains(m, F.lit("报表")) & ~daily & ~monthly
    number = lambda p, k=1: F.nullif(F.regexp_extract(m, p, k), F.lit("")).try_cast("int")
    recent, hours = number(r"近(\d+)日"), number(r"(\d+)小时(?:1次|一次)")
    fits = recent.isNull() | recent.between(FEWEST_DAYS, MOST_DAYS)
    day_form, month_form = r"(\d{4})(?:年|-|/)(\d{1,2})(?:月|-|/)(\d{1,2})日?", r"(\d{4})(?:年|-|/)(\d{1,2})月?"
    valid = lambda p, *k: F.try_to_date(F.concat_ws("-", F.lpad(number(p, 1).cast("string"), 4, "0"), *[F.lpad(number(p, i).cast("string"), 2, "0") for i in k[1:]], *([F.lit("01")] if len(k) == 2 else [])), "yyyy-MM-dd")
    has_day, day = m.rlike(day_form), valid(day_form, 1, 2, 3)
    has_month, month = m.rlike(month_form), valid(month_form, 1, 2)
    by_word = F.when(m.rlike("昨天|昨日"), F.date_sub(today, 1)).otherwise(today)
    of_day = F.struct(F.lit("daily").alias("type"), F.when(has_day, F.coalesce(day, today)).otherwise(by_word).alias("period"), F.when(fits, F.coalesce(recent, F.lit(DAYS))).otherwise(DAYS).alias("recent_days"), hours.alias("hours"), generic.alias("selectable"),
                      F.when(has_day & day.isNull(), "day").when(~fits, "recent_days").alias("error"))
    of_month = F.struct(F.lit("monthly").alias("type"), F.coalesce(F.when(has_month, month), F.trunc(today, "month")).alias("period"), F.lit(DAYS).alias("recent_days"), hours.alias("hours"), F.lit(False).alias("selectable"),
                        F.when(has_month & month.isNull(), "month").when(~fits, "recent_days").alias("error"))
    return F.when((daily | monthly | generic) & m.rlike(MAKE), F.when(daily | generic, of_day).otherwise(of_month))


def named_indicators(message: Column) -> Column:
    """The indicators that a message names, as an array of their words; null if it names none."""
    m = _plain(message)
    raw = F.when(m.rlike(NAMED[0]), F.regexp_extract(m, NAMED[0], 1)).when(m.rlike(NAMED[1]), F.regexp_extract(m, NAMED[1], 1))
    terms = F.transform(F.split(F.regexp_replace(raw, "(?:水质)?(?:日报|月报)", ""), _PARTS), lambda t: F.regexp_replace(t, f"^[{_ENDS}]+|[{_ENDS}]+$", ""))
    return F.array_remove(terms, "")


def resolved_indicators(message: Column, available: list[str]) -> Column:
    """known: those of the available indicators that a message names, once each; unknown: its other words. Null if it names none."""
    names = {x.strip().lower(): x for x in available}
    table_of = F.create_map(*[F.lit(v) for pair in {**names, **{a: names[b] for a, b in ALIASES.items() if b in names}}.items() for v in pair])
    terms = named_indicators(message)
    found = F.transform(terms, lambda t: F.struct(t.alias("term"), F.try_element_at(table_of, F.lower(t)).alias("name")))
    return F.when(terms.isNotNull(), F.struct(F.array_distinct(F.array_compact(F.transform(found, lambda x: x["name"]))).alias("known"), F.transform(F.filter(found, lambda x: x["name"].isNull()), lambda x: x["term"]).alias("unknown")))


def selection_error(codes: Column, overrides: Column, allowed: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with error: why a selection can't stand, or null. codes: array of indicators, or null for all; overrides: map of
    indicator to hours. allowed: code, hours, a bounded table of what stations are set to, broadcast."""
    known = allowed.groupBy("code").agg(F.collect_set("hours").alias("hours")).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("code", "hours"))).alias("_allowed"))
    keys = F.map_keys(overrides)
    error = (F.when(codes.isNotNull() & (F.size(F.array_except(codes, F.map_keys("_allowed"))) > 0), "unknown_indicator").when(codes.isNotNull() & (F.size(F.array_except(keys, codes)) > 0), "override_of_other_indicator")
             .when(F.size(F.array_except(keys, F.map_keys("_allowed"))) > 0, "unknown_override").when(F.exists(F.map_entries(overrides), lambda e: ~F.array_contains(F.try_element_at(F.col("_allowed"), e["key"]), e["value"])), "unknown_frequency"))
    return rows.join(F.broadcast(known)).withColumn("error", error).drop("_allowed")


def chart_type(text: Column) -> Column:
    """The type of chart that a text names, or null."""
    out = F.when(text.rlike(CHARTS[0][0]), CHARTS[0][1])
    for words, kind in CHARTS[1:]:
        out = out.when(text.rlike(words), kind)
    return out


def chart_switch(message: Column) -> Column:
    """The type that a message switches the chart to, if it says no more than that."""
    m = F.trim(message)
    begun = F.when(m.rlike(f"^(?:{SWITCH})"), chart_type(F.regexp_replace(m, f"^(?:{SWITCH})", "")))
    used = F.when(m.rlike(f"^用.*(?:{SHOWN})$"), chart_type(F.regexp_extract(m, f"^用(.*?)(?:{SHOWN})$", 1)))
    return F.coalesce(begun, used, F.when((F.length(m) <= 6) & ~m.rlike("^(加|再|补充|新增|追加)"), chart_type(m)))


def chart_append(message: Column) -> Column:
    """The type of a chart that a message adds, if it says no more than that and isn't a question."""
    m = F.trim(message)
    return F.when(~m.rlike("[吗?？]") & m.rlike(f"^(?:{APPEND})"), chart_type(F.regexp_replace(F.regexp_replace(m, f"^(?:{APPEND})", ""), f"(?:{SHOWN})$", "")))


def column_label(name: Column, own: Column, labels: dict[str, str], cases: dict[str, str], words: dict[str, str]) -> Column:
    """A column's label: its own, if there is one; a name with Chinese letters as it is; by the name's label or case; by its
    words' labels, if all have one; else the name. labels, cases, words: rules by lower-case names, bounded."""
    of = lambda rules: F.create_map(*[F.lit(v) for pair in rules.items() for v in pair]) if rules else F.create_map().cast("map<string,string>")
    low, tokens = F.lower(name), F.array_remove(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+"), "")
    told = F.transform(tokens, lambda t: F.try_element_at(of(words), t))
    joined = F.when((F.size(told) > 0) & F.forall(told, lambda x: x.isNotNull()), F.array_join(told, ""))
    return F.coalesce(F.nullif(own, F.lit("")), F.when(name.rlike("[一-龥]"), name), F.try_element_at(of(labels), low), F.try_element_at(of(cases), low), joined, name)


def table_headers(markdown: Column) -> Column:
    """The headers of the first table in a text of Markdown, or null."""
    head = F.regexp_extract(F.concat(F.lit("\n"), markdown), r"\n[ \t]*\|([^\n]*)\|[ \t]*\r?\n[ \t]*\|[\s\-:|]+\|[ \t]*\r?(?=\n|\z)", 1)
    return F.when(head != "", F.array_remove(F.transform(F.split(head, r"\|"), lambda x: F.trim(x)), ""))


def header_labels(columns: Column, headers: Column) -> Column:
    """Map of columns to headers; a first header that numbers rows is left out. Null if their numbers differ."""
    extra = (F.size(headers) == F.size(columns) + 1) & (F.size(headers) >= 2) & F.get(headers, F.lit(0)).rlike(ROW_NUMBER)
    own = F.when(extra, F.slice(headers, F.lit(2), F.greatest(F.size(headers) - 1, F.lit(0)))).otherwise(headers)
    return F.when(F.size(own) == F.size(columns), F.map_from_arrays(columns, own))


def date_range(matches: Column) -> Column:
    """granularity (month or day) and days of the first column whose comparisons bound it. matches: array of structs (column,
    op, literal) in the order of the text."""
    columns = F.array_distinct(F.transform(matches, lambda m: m["column"]))
    first = lambda c, ops: F.to_date(F.substring(F.get(F.filter(matches, lambda m: (m["column"] == c) & m["op"].isin(*ops)), F.lit(0))["literal"], 1, 10))
    ranges = F.transform(columns, lambda c: F.struct(first(c, (">=", ">")).alias("start"), first(c, ("<", "<=")).alias("end")))
    r = F.get(F.filter(ranges, lambda x: x["start"].isNotNull() | x["end"].isNotNull()), F.lit(0))
    both = r["start"].isNotNull() & r["end"].isNotNull()
    month = both & (F.dayofmonth(r["start"]) == 1) & (r["end"] == F.add_months(r["start"], 1))
    return F.struct(F.when(month, "month").otherwise("day").alias("granularity"), F.when(month, 0).when(both, F.datediff(r["end"], r["start"])).otherwise(1).alias("days"))


def _pick(s: SparkSession, d: str, texts: tuple[str, ...], name: str = "text") -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", "o_custkey", F.get(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % len(texts)).cast("int")).alias(name))


_REPORTS = ("生成2024年3月5日日报", "导出 2024年2月 月报", "给我昨日日报 近5日", "日报怎么看", "创建报表 4小时1次", "制作2024-02-31日报", "生成日报近9日", "出一份月报", "查询水质")
_today = lambda: F.lit("2024-03-10").cast("date")
register("W23_report_intent", lambda s, d: _pick(s, d, _REPORTS).select("o_orderkey", report_intent(F.col("text"), _today()).alias("r")).select("o_orderkey", *[F.col(f"r.{c}").alias(c) for c in ("type", "period", "recent_days", "hours", "selectable", "error")]), """
SELECT o_orderkey, CASE WHEN k IN (0, 2, 4, 5, 6) THEN 'daily' WHEN k IN (1, 7) THEN 'monthly' END AS type,
  CASE k WHEN 0 THEN DATE '2024-03-05' WHEN 1 THEN DATE '2024-02-01' WHEN 2 THEN DATE '2024-03-09' WHEN 4 THEN DATE '2024-03-10' WHEN 5 THEN DATE '2024-03-10' WHEN 6 THEN DATE '2024-03-10' WHEN 7 THEN DATE '2024-03-01' END AS period,
  CASE WHEN k = 2 THEN 5 WHEN k NOT IN (3, 8) THEN 3 END AS recent_days, CASE WHEN k = 4 THEN 4 END AS hours, CASE WHEN k NOT IN (3, 8) THEN k = 4 END AS selectable, CASE k WHEN 5 THEN 'day' WHEN 6 THEN 'recent_days' END AS error
FROM (SELECT o_orderkey, o_orderkey % 9 AS k FROM orders)""")
_ASKS = ("只看氨氮、总磷和pH值", "生成日报，关注codmn和别的近3日", "查看总磷指标", "生成日报", "只要总磷，总磷")
register("W24_indicators", lambda s, d: _pick(s, d, _ASKS).select("o_orderkey", resolved_indicators(F.col("text"), ["pH", "氨氮", "总磷", "高锰酸盐指数"]).alias("r")).select("o_orderkey", F.array_join("r.known", ",").alias("known"), F.array_join("r.unknown", ",").alias("unknown")), """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '氨氮,总磷,pH' WHEN 1 THEN '高锰酸盐指数' WHEN 2 THEN '总磷' WHEN 4 THEN '总磷' END AS known, CASE o_orderkey % 5 WHEN 1 THEN '别' WHEN 3 THEN NULL ELSE '' END AS unknown FROM orders""")


def _selections(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.array((F.col("o_orderkey") % 4).cast("int"), F.lit(1))).alias("codes"), F.create_map((F.col("o_custkey") % 4).cast("int"), (F.col("o_custkey") % 2 + 1).cast("int")).alias("overrides"))
    allowed = s.createDataFrame([(0, 1), (1, 1), (1, 2), (2, 2)], "code int, hours int")
    return selection_error(F.col("codes"), F.col("overrides"), allowed, rows).select("o_orderkey", "error")


register("W22_selection", _selections, """
WITH f AS (SELECT o_orderkey, o_orderkey % 3 > 0 AS chosen, o_orderkey % 4 AS c, o_custkey % 4 AS o, o_custkey % 2 + 1 AS h FROM orders)
SELECT o_orderkey, CASE WHEN chosen AND c = 3 THEN 'unknown_indicator' WHEN chosen AND o <> c AND o <> 1 THEN 'override_of_other_indicator' WHEN o = 3 THEN 'unknown_override' WHEN NOT (o = 0 AND h = 1 OR o = 1 OR o = 2 AND h = 2) THEN 'unknown_frequency' END AS error FROM f""")
_CHATS = ("改成饼图", "用横向柱状图显示", "折线图", "再加一张散点图展示", "加个饼图吗？", "请问柱状图怎么看", "柱状折线图", "用表格显示", "切换为 雷达图 ")
register("H10_chart_phrases", lambda s, d: _pick(s, d, _CHATS).select("o_orderkey", chart_type(F.col("text")).alias("named"), chart_switch(F.col("text")).alias("switch"), chart_append(F.col("text")).alias("append")), """
SELECT o_orderkey, CASE k WHEN 0 THEN 'pie' WHEN 1 THEN 'horizontal_bar' WHEN 2 THEN 'line' WHEN 3 THEN 'scatter' WHEN 4 THEN 'pie' WHEN 5 THEN 'bar' WHEN 6 THEN 'combo' WHEN 8 THEN 'radar' END AS named,
  CASE k WHEN 0 THEN 'pie' WHEN 1 THEN 'horizontal_bar' WHEN 2 THEN 'line' WHEN 6 THEN 'combo' WHEN 8 THEN 'radar' END AS switch, CASE k WHEN 3 THEN 'scatter' END AS append FROM (SELECT o_orderkey, o_orderkey % 9 AS k FROM orders)""")
_COLS = ("station_name", "COD", "total_price", "名称", "stationCount", "ph_value", "x")
register("E7_column_labels", lambda s, d: _pick(s, d, _COLS).select("o_orderkey", column_label(F.col("text"), F.when(F.col("o_custkey") % 5 == 0, "own"), {"station_name": "Station"}, {"cod": "COD", "ph": "pH"}, {"total": "Total", "price": "Price", "station": "Station", "count": "Count", "ph": "pH"}).alias("label")), """
SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'own' ELSE CASE o_orderkey % 7 WHEN 0 THEN 'Station' WHEN 1 THEN 'COD' WHEN 2 THEN 'TotalPrice' WHEN 3 THEN '名称' WHEN 4 THEN 'StationCount' WHEN 5 THEN 'ph_value' ELSE 'x' END END AS label FROM orders""")
_TABLES = ("text\n| No. | Name | n |\n|---|:--:|---|\n| 1 | a | 2 |", "| Name | n |\n| --- | --- |", "| Name | n |\nno line", "|Name|\n|-|\n", "nothing")
register("E8_header_labels", lambda s, d: _pick(s, d, _TABLES).select("o_orderkey", table_headers(F.col("text")).alias("h")).select("o_orderkey", F.array_join("h", ",").alias("headers"), F.to_json(header_labels(F.array(F.lit("a"), F.lit("b")), F.col("h"))).alias("labels")), """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'No.,Name,n' WHEN 1 THEN 'Name,n' WHEN 3 THEN 'Name' END AS headers, CASE WHEN o_orderkey % 5 <= 1 THEN '{"a":"Name","b":"n"}' END AS labels FROM orders""")


def _ranges(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    one = lambda c, op, day: F.struct(F.lit(c).alias("column"), F.lit(op).alias("op"), F.date_format(day, "yyyy-MM-dd").alias("literal"))
    day, first = F.to_date("o_orderdate"), F.trunc("o_orderdate", "month")
    matches = F.when(k % 5 == 0, F.array(one("t", ">=", first), one("t", "<", F.add_months(first, 1)))).when(k % 5 == 1, F.array(one("u", "=", day), one("t", "<=", F.date_add(day, 7)), one("t", ">", day))).when(k % 5 == 2, F.array(one("t", ">=", day)))
    return table(s, d, "orders").select("o_orderkey", date_range(F.coalesce(matches.when(k % 5 == 3, F.array(one("t", ">=", day), one("t", "<", F.date_add(day, (k % 40).cast("int"))))), F.array().cast("array<struct<column:string,op:string,literal:string>>"))).alias("r")).select("o_orderkey", "r.granularity", "r.days")


register("Q3_date_range", _ranges, """
WITH f AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderkey % 40 AS n FROM orders), g AS (SELECT k, n, k % 5 = 0 OR k % 5 = 3 AND day(d) = 1 AND d + CAST(n AS INTEGER) = d + INTERVAL 1 MONTH AS m FROM f)
SELECT k AS o_orderkey, CASE WHEN m THEN 'month' ELSE 'day' END AS granularity, CAST(CASE WHEN m THEN 0 WHEN k % 5 = 1 THEN 7 WHEN k % 5 = 3 THEN n ELSE 1 END AS INTEGER) AS days FROM g""")
