"""Descriptive statistics of a series, and cells as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import to_number
from ..registry import register
from ..sources.tables import table


def summary(df: DataFrame, x: str, y: str, drop_negative: bool = False) -> DataFrame:
    """count, total, average, the largest and smallest item and their ratio (null with 0, mixed signs, or below 1.05)."""
    rows = df.select(F.col(x).alias("x"), to_number(F.col(y)).alias("y")).filter("y IS NOT NULL")
    if drop_negative:
        rows = rows.filter("y >= 0")
    got = rows.agg(F.count("*").alias("n"), F.sum("y").alias("total"), F.avg("y").alias("average"), F.max("y").alias("most"), F.min("y").alias("least"),
                   F.max_by("x", F.struct("y", "x")).alias("most_at"), F.min_by("x", F.struct("y", "x")).alias("least_at"))
    ratio = F.try_divide("most", "least")
    return got.withColumn("ratio", F.when((F.col("least") * F.col("most") > 0) & (ratio >= 1.05), ratio))


def top_three(df: DataFrame, x: str, y: str) -> DataFrame:
    """The three largest items with their share of the total in percent, to one digit."""
    rows = df.select(F.col(x).alias("x"), to_number(F.col(y)).alias("y")).filter("y IS NOT NULL")
    total = rows.agg(F.sum("y").alias("total"))
    return rows.orderBy(F.desc("y"), "x").limit(3).join(F.broadcast(total)).select("x", "y", F.round(F.try_divide(100 * F.col("y"), F.col("total")), 1).alias("share"))


def change(df: DataFrame, order: str, y: str) -> DataFrame:
    """First and last value by order, the change in percent if both are positive, and its direction beyond 5 percent."""
    ends = df.agg(F.min_by(y, order).alias("first"), F.max_by(y, order).alias("last"))
    by = F.when((F.col("first") > 0) & (F.col("last") > 0), (F.col("last") - F.col("first")) / F.col("first"))
    return ends.withColumn("percent", F.round(100 * by, 2)).withColumn("direction", F.when(by > 0.05, "up").when(by < -0.05, "down").when(by.isNotNull(), "steady"))


def number_text(value: Column) -> Column:
    """A number as text: whole ones as they are, others with at most two decimals."""
    whole = F.floor(value) == value
    return F.when(whole, F.format_string("%.0f", value)).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), r"\.$", ""))


def cell_text(value: Column) -> Column:
    """A cell as text: a dash for null, the day of a date and time."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.substring(text, 1, 10)).otherwise(text)


def category_text(df: DataFrame, x: str, y: str, item: str, metric: str, additive: bool = True, drop_negative: bool = False) -> DataFrame:
    """text: what bars or slices show: how many there are, the sum (of additive metrics) or mean, the ends, the first three and
    how far the ends are apart. No row of numbers gives null. Ties go to the first x."""
    rows = df.select(F.col(x).cast("string").alias("x"), to_number(F.col(y)).alias("y")).filter("y IS NOT NULL")
    rows = rows.filter("y >= 0") if drop_negative else rows
    got = rows.agg(F.count("*").alias("n"), F.sum("y").alias("sum"), F.avg("y").alias("mean"), F.max("y").alias("most"), F.min("y").alias("least"), F.min("x").alias("_"))
    ranked = rows.orderBy(F.desc("y"), "x").limit(3).agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("k"), "x"))).alias("top"))
    last = rows.orderBy("y", F.desc("x")).limit(1).select(F.col("x").alias("last"))
    c, num, top = F.col, number_text, F.transform("top", lambda t: t["x"])
    share = lambda part: F.when(c("sum") > 0, F.format_string("%.1f%%", 100 * part / c("sum"))).otherwise("0%")
    first, three = F.get(top, F.lit(0)), F.aggregate("top", F.lit(0.0), lambda a, t: a - t["k"])
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    many = c("n").cast("string")
    ratio = F.when((c("most") * c("least") > 0), F.greatest(F.abs("most"), F.abs("least")) / F.least(F.abs("most"), F.abs("least")))
    times = F.round(ratio, 1)
    degree = F.when(times >= 5, "差异较大").when(times >= 2, "差异较明显").otherwise("存在一定差异")
    if additive:
        text = say("共", many, f"个{item}，{metric}合计", num(c("sum")), "。", first, "最多，为", num(c("most")), "，占", share(c("most")), "；", c("last"), "最少，为", num(c("least")), "。",
                   F.when(c("n") >= 3, say(f"前3个{item}（", F.array_join(top, "、"), "）合计占", share(three), "。")).otherwise(""),
                   F.when(ratio >= 1.05, say(first, "约为", c("last"), "的", F.format_string("%.1f倍", ratio), f"，{item}间", degree, "。")).otherwise(""))
    else:
        text = say("共", many, f"个{item}，{metric}均值", num(c("mean")), "。", first, "最高，为", num(c("most")), "；", c("last"), "最低，为", num(c("least")), "。")
    return got.join(F.broadcast(ranked)).join(last, F.lit(True), "left").select(F.when(c("n") > 0, text).alias("text"))  # one row each


def _by_nation(s, d):
    return table(s, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("y"))


_N = "WITH n AS (SELECT c_nationkey AS x, round(sum(c_acctbal), 2) AS y FROM customer GROUP BY 1) "
register("E1_summary", lambda s, d: summary(_by_nation(s, d), "c_nationkey", "y").select("n", F.round("total", 2).alias("total"), F.round("average", 2).alias("average"), "most", "least", "most_at", "least_at", F.round("ratio", 6).alias("ratio")),
         _N + "SELECT count(*) AS n, round(sum(y), 2) AS total, round(avg(y), 2) AS average, max(y) AS most, min(y) AS least, arg_max(x, y) AS most_at, arg_min(x, y) AS least_at, CASE WHEN min(y) * max(y) > 0 AND max(y) / min(y) >= 1.05 THEN round(max(y) / min(y), 6) END AS ratio FROM n")
register("E2_top_shares", lambda s, d: top_three(_by_nation(s, d), "c_nationkey", "y"), _N + "SELECT x, y, round(100 * y / (SELECT sum(y) FROM n), 1) AS share FROM n ORDER BY y DESC, x LIMIT 3")
register("E3_first_last_change", lambda s, d: change(table(s, d, "events"), "ts", "value"), """
WITH e AS (SELECT arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM events), r AS (SELECT *, CASE WHEN first > 0 AND last > 0 THEN (last - first) / first END AS c FROM e)
SELECT first, last, round(100 * c, 2) AS percent, CASE WHEN c > 0.05 THEN 'up' WHEN c < -0.05 THEN 'down' WHEN c IS NOT NULL THEN 'steady' END AS direction FROM r
""")
register("E5_number_text", lambda s, d: table(s, d, "lineitem").select(number_text(F.col("l_quantity")).alias("q"), number_text(F.col("l_discount")).alias("d")).distinct(),
         "SELECT DISTINCT printf('%.0f', l_quantity) AS q, CASE WHEN floor(l_discount) = l_discount THEN printf('%.0f', l_discount) ELSE rtrim(rtrim(printf('%.2f', l_discount), '0'), '.') END AS d FROM lineitem")
register("E6_cell_text", lambda s, d: table(s, d, "orders").select("o_orderkey", cell_text(F.col("o_orderdate")).alias("day"), cell_text(F.nullif("o_orderstatus", F.lit("F"))).alias("status")),
         "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, coalesce(nullif(o_orderstatus, 'F'), '-') AS status FROM orders")
register("E9_preview", lambda s, d: table(s, d, "part").orderBy("p_partkey").limit(5), "SELECT * FROM part ORDER BY p_partkey LIMIT 5")
_per_segment = lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
register("E4_category_text", lambda s, d: category_text(_per_segment(s, d), "c_mktsegment", "n", "segment", "customers"), """
WITH n AS (SELECT c_mktsegment AS x, count(*) AS y FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY y DESC, x) AS k FROM n),
a AS (SELECT count(*) AS n, sum(y) AS s, max(y) AS m, min(y) AS l, max(x) FILTER (k = 1) AS f, arg_max(x, k) AS e, string_agg(x, '、' ORDER BY k) FILTER (k <= 3) AS t, sum(y) FILTER (k <= 3) AS h FROM r)
SELECT '共' || n || '个segment，customers合计' || s || '。' || f || '最多，为' || m || '，占' || printf('%.1f%%', 100.0::DOUBLE * m / s) || '；' || e || '最少，为' || l || '。前3个segment（' || t || '）合计占' || printf('%.1f%%', 100.0::DOUBLE * h / s) || '。'
  || CASE WHEN m / l >= 1.05 THEN f || '约为' || e || '的' || printf('%.1f倍', m::DOUBLE / l) || '，segment间' || CASE WHEN round(m::DOUBLE / l, 1) >= 5 THEN '差异较大' WHEN round(m::DOUBLE / l, 1) >= 2 THEN '差异较明显' ELSE '存在一定差异' END || '。' ELSE '' END AS text FROM a""")
register("E4_mean_text", lambda s, d: category_text(table(s, d, "nation").groupBy("n_regionkey").agg(F.max("n_nationkey").alias("v")), "n_regionkey", "v", "region", "largest key", additive=False),
         "WITH n AS (SELECT n_regionkey AS x, max(n_nationkey) AS y FROM nation GROUP BY 1) SELECT '共' || count(*) || '个region，largest key均值' || CASE WHEN avg(y) = floor(avg(y)) THEN printf('%.0f', avg(y)) ELSE rtrim(rtrim(printf('%.2f', avg(y)), '0'), '.') END || '。' || arg_max(x, y * 100 - x) || '最高，为' || max(y) || '；' || arg_min(x, y * 100 - x) || '最低，为' || min(y) || '。' AS text FROM n")
