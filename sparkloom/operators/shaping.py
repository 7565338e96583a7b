"""Rows as the chart types need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import at_most, is_blank, to_number
from ..registry import register
from ..sources.tables import table

#: What is still a chart: slices of a pie, entities of a chart of several, and times of each.
SLICES, SERIES, POINTS = 10_000, 10_000, 100_000


def clean(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a blank in any of the columns."""
    for c in columns:
        df = df.filter(~is_blank(F.col(c)))
    return df


def sort_key(x: Column) -> Column:
    """A number by which an axis sorts: a date's time, a quarter of a year, a month or quarter alone, or a number."""
    text = x.cast("string")
    date = F.try_to_timestamp(text)
    quarter = F.regexp_extract(text, r"(?i)^(\d{4})\D*Q?([1-4])\D?$", 1)
    alone = F.regexp_extract(text, r"(?i)^Q([1-4])$", 1)
    month = F.regexp_extract(text, "^(\\d{1,2})月$", 1)
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}(-\d{2})?"), F.unix_micros(date) / 1000.0),
        F.when(quarter != "", quarter.try_cast("double") * 10 + F.regexp_extract(text, r"([1-4])\D?$", 1).try_cast("double")),
        F.when(month != "", month.try_cast("double")), F.when(alone != "", alone.try_cast("double")), to_number(x))


def shares(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y, share in percent to one digit, and rank: equal values share one. Null shares where a value is negative or
    nothing sums up."""
    whole = df.agg(F.sum(y).alias("_total"), (F.min(y) >= 0).alias("_ok"))
    # equal values are one row here, so the only window over all takes no more rows than there are values
    places = df.groupBy(F.col(y).alias("_y")).agg(F.count("*").alias("_n")).withColumn("_rank", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_y")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    both = df.join(F.broadcast(whole)).join(places, F.col(y).eqNullSafe(F.col("_y")))
    return both.select(x, y, F.when(F.col("_ok") & (F.col("_total") > 0), F.round(100 * F.col(y) / F.col("_total"), 1)).alias("share"), F.col("_rank").cast("int").alias("rank"))


def pie(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slices, the largest first, with their place and the total. More than SLICES are no pie: ValueError."""
    total = df.agg(F.sum(y).alias("total"))  # one row
    return at_most(df, SLICES, "a pie's slices").withColumn("place", F.row_number().over(Window.orderBy(F.desc(y), x))).join(F.broadcast(total)).select(x, y, "place", "total")


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Points whose x and y are numbers."""
    return df.select(to_number(F.col(x)).alias("x"), to_number(F.col(y)).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")


def bubbles(df: DataFrame, x: str, y: str, size: str) -> DataFrame:
    """Points and a radius from 10 to 44 by the root of the size's place between its extremes; 27 if all are alike."""
    rows = df.select(*[to_number(F.col(c)).alias(n) for c, n in ((x, "x"), (y, "y"), (size, "size"))]).dropna()
    ends = rows.agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    return rows.join(F.broadcast(ends)).select("x", "y", F.when(F.col("hi") == F.col("lo"), 27.0).otherwise(10 + F.sqrt((F.col("size") - F.col("lo")) / (F.col("hi") - F.col("lo"))) * 34).alias("radius"))


def radar(df: DataFrame, indicators: list[str]) -> DataFrame:
    """indicator, most, axis: the least whole number of 1.2 times the most, 1 if that is 0."""
    most = df.agg(*[F.max(to_number(F.col(c))).alias(c) for c in indicators])
    long = most.unpivot([], indicators, "indicator", "most")
    axis = F.ceil(F.col("most") * 1.2)
    return long.select("indicator", "most", F.when(axis == 0, 1).otherwise(axis).cast("long").alias("axis"))


def heatmap(df: DataFrame, x: str, y: str, value: str, order: str) -> DataFrame:
    """Cells with the places of x and y by first sight in `order`, and the scale's ends."""
    rows = df.select(F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y"), to_number(F.col(value)).alias("v"), F.col(order).alias("o")).filter("v IS NOT NULL")
    place = lambda c: rows.groupBy(c).agg(F.min("o").alias("f")).select(c, (F.dense_rank().over(Window.orderBy("f")) - 1).alias(f"{c}_place"))
    cells = rows.groupBy("x", "y").agg(F.sum("v").alias("v"))
    ends = cells.agg(F.least(F.min("v"), F.lit(0.0)).alias("low"), F.greatest(F.max("v"), F.lit(1.0)).alias("high"))
    return cells.join(place("x"), "x").join(place("y"), "y").join(F.broadcast(ends))  # one row of ends


def quartiles(df: DataFrame, x: str, y: str) -> DataFrame:
    """Five numbers by x with interpolated quartiles."""
    at = lambda q: F.percentile(F.col(y), F.lit(q))
    return df.groupBy(x).agg(F.min(y).alias("min"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max(y).alias("max"))


def gauge(df: DataFrame, value: str, order: str) -> DataFrame:
    """The first value that is not null, and the scale's end."""
    first = df.filter(F.col(value).isNotNull()).agg(F.min_by(value, order).alias("value"))
    return first.select("value", F.greatest(F.col("value") * 1.5, F.lit(100.0)).alias("most"))


def combo(df: DataFrame, x: str, bar: str, line: str | None = None) -> DataFrame:
    """x, a bar's column and a line's: the next numeric one if none is named."""
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")]
    line = line or next(c for c in numeric if c not in (x, bar))
    return df.select(F.col(x).alias("x"), F.col(bar).alias("bar"), F.col(line).alias("line"))


def series(df: DataFrame, entity: str, time: str, value: str, order: str) -> DataFrame:
    """Every entity at every time; of several rows of a cell the last in `order` counts, missing cells are null.

    More than SERIES entities or POINTS times are no chart: ValueError."""
    cells = df.groupBy(entity, time).agg(F.max_by(value, order).alias(value))
    names, times = at_most(cells.select(entity).distinct(), SERIES, "a chart's entities"), at_most(cells.select(time).distinct(), POINTS, "a chart's times")
    # a chart's entities times its times: the picture itself, of a size that was checked
    return names.crossJoin(times).join(cells, [entity, time], "left")


def area_ok(df: DataFrame, time: str, value: str, entity: str | None = None) -> DataFrame:
    """Whether an area may be drawn: at least two rows and times, all values numbers, at most one entity."""
    one = F.count_distinct(entity) <= 1 if entity else F.lit(True)
    return df.agg(((F.count("*") >= 2) & (F.count_distinct(time) >= 2) & F.bool_and(to_number(F.col(value)).isNotNull()) & one).alias("ok"))


def _by_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q")).select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("flag"), "q")


_FLAGS = "WITH f AS (SELECT concat_ws('-', l_returnflag, l_linestatus) AS flag, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus) "
_day = lambda c: F.to_date(c)
register("V1_clean_rows", lambda s, d: clean(table(s, d, "part").withColumn("b", F.when(F.col("p_size") > 25, F.col("p_brand")).when(F.col("p_size") > 10, "")), "b").select("p_partkey", "b"),
         "SELECT p_partkey, p_brand AS b FROM part WHERE p_size > 25")
register("V2_axis_series", lambda s, d: table(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("x")).agg(F.round(F.sum("o_totalprice"), 2).alias("y")).select("x", "y", F.row_number().over(Window.orderBy(sort_key(F.col("x")))).alias("place")),
         "SELECT x, y, CAST(row_number() OVER (ORDER BY x) AS INTEGER) AS place FROM (SELECT strftime(o_orderdate, '%Y-%m') AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1)")
register("V3_shares", lambda s, d: shares(_by_flag(s, d), "flag", "q"), _FLAGS + "SELECT flag, q, round(100 * q / sum(q) OVER (), 1) AS share, CAST(rank() OVER (ORDER BY q DESC) AS INTEGER) AS rank FROM f")
register("V4_pie", lambda s, d: pie(_by_flag(s, d), "flag", "q"), _FLAGS + "SELECT flag, q, CAST(row_number() OVER (ORDER BY q DESC, flag) AS INTEGER) AS place, sum(q) OVER () AS total FROM f")
register("V5_scatter", lambda s, d: scatter(table(s, d, "part").withColumn("v", F.when(F.col("p_size") % 5 == 0, "?").otherwise(F.col("p_size").cast("string"))), "v", "p_retailprice").groupBy("x").agg(F.count("*").alias("n"), F.max("y").alias("top")),
         "SELECT CAST(p_size AS DOUBLE) AS x, count(*) AS n, max(p_retailprice) AS top FROM part WHERE p_size % 5 <> 0 GROUP BY 1")
register("V6_bubbles", lambda s, d: bubbles(table(s, d, "part"), "p_partkey", "p_size", "p_retailprice").select("x", "y", F.round("radius", 6).alias("radius")),
         "WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT CAST(p_partkey AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, round(10 + sqrt((p_retailprice - lo) / (hi - lo)) * 34, 6) AS radius FROM part, e")
register("V7_radar", lambda s, d: radar(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]),
         " UNION ALL ".join(f"SELECT '{c}' AS indicator, max({c}) AS most, CAST(CASE WHEN ceil(max({c}) * 1.2::DOUBLE) = 0 THEN 1 ELSE ceil(max({c}) * 1.2::DOUBLE) END AS BIGINT) AS axis FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
register("V8_heatmap", lambda s, d: heatmap(table(s, d, "orders").withColumn("one", F.lit(1.0)), "o_orderstatus", "o_orderpriority", "one", "o_orderkey"), """
WITH x AS (SELECT o_orderstatus AS x, CAST(dense_rank() OVER (ORDER BY min(o_orderkey)) - 1 AS INTEGER) AS x_place FROM orders GROUP BY 1),
y AS (SELECT o_orderpriority AS y, CAST(dense_rank() OVER (ORDER BY min(o_orderkey)) - 1 AS INTEGER) AS y_place FROM orders GROUP BY 1),
c AS (SELECT o_orderstatus AS x, o_orderpriority AS y, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)
SELECT c.x, c.y, v, x_place, y_place, least(min(v) OVER (), 0.0::DOUBLE) AS low, greatest(max(v) OVER (), 1.0::DOUBLE) AS high FROM c JOIN x ON c.x = x.x JOIN y ON c.y = y.y
""")
register("V9_quartiles", lambda s, d: quartiles(table(s, d, "customer"), "c_mktsegment", "c_acctbal").select("c_mktsegment", *[F.round(c, 3).alias(c) for c in ("min", "q1", "median", "q3", "max")]),
         "SELECT c_mktsegment, round(min(c_acctbal), 3) AS min, round(quantile_cont(c_acctbal, 0.25), 3) AS q1, round(median(c_acctbal), 3) AS median, round(quantile_cont(c_acctbal, 0.75), 3) AS q3, round(max(c_acctbal), 3) AS max FROM customer GROUP BY 1")
register("V10_gauge", lambda s, d: gauge(table(s, d, "events").withColumn("v", F.when(F.col("event_type") == "click", F.col("value"))), "v", "event_id"),
         "SELECT value, greatest(value * 1.5::DOUBLE, 100.0::DOUBLE) AS most FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 1")
register("V11_combo", lambda s, d: combo(table(s, d, "part").select("p_name", "p_size", "p_retailprice"), "p_name", "p_size"), 'SELECT p_name AS x, p_size AS bar, p_retailprice AS line FROM part')
register("V12_series", lambda s, d: series(table(s, d, "events").withColumn("day", _day("ts")), "event_type", "day", "value", "event_id"), """
WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)
SELECT e.event_type, t.day, c.value FROM (SELECT DISTINCT event_type FROM c) e CROSS JOIN (SELECT DISTINCT day FROM c) t LEFT JOIN c ON c.event_type = e.event_type AND c.day = t.day
""")
register("V13_area_ok", lambda s, d: area_ok(table(s, d, "events"), "ts", "value"), "SELECT count(*) >= 2 AND count(DISTINCT ts) >= 2 AND bool_and(value IS NOT NULL) AS ok FROM events")
register("V14_sort_key", lambda s, d: table(s, d, "orders").select(F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("x")).distinct().select("x", sort_key(F.col("x")).alias("k")),
         "SELECT DISTINCT concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS x, CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS DOUBLE) AS k FROM orders")
