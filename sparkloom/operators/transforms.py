"""Reshaping of result sets: grouped sums, five-number summaries, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import is_blank, key_text, round_stored, to_number
from ..registry import register
from ..sources.tables import table

#: What a summary's columns are called; a group's column may not be.
STATS = ("min", "Q1", "median", "Q3", "max")


class TransformError(Exception):
    """A call that can't be carried out; .code says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _key(df: DataFrame, name: str) -> Column:
    return key_text(F.col(name)) if isinstance(df.schema[name].dataType, T.NumericType) else F.col(name).cast("string")


def group_by_sum(df: DataFrame, x: str | None, ys: list[str]) -> DataFrame:
    """Sums of ys by x. Blank keys go; a group stands if any y of its rows is a number; others add 0; x becomes text."""
    if not x or x not in df.columns:
        raise TransformError("missing_xField")
    if not ys:
        raise TransformError("missing_yFields")
    ys = [y for y in dict.fromkeys(ys) if y in df.columns]
    if not ys:
        raise TransformError("no_valid_yFields")
    numbers = [to_number(F.col(y)).alias(y) for y in ys]
    rows = df.filter(~is_blank(F.col(x))).select(_key(df, x).alias(x), *numbers)
    any_number = F.greatest(*[F.col(y).isNotNull() for y in ys]) if len(ys) > 1 else F.col(ys[0]).isNotNull()
    return rows.filter(any_number).groupBy(x).agg(*[F.sum(F.coalesce(y, F.lit(0.0))).alias(y) for y in ys])


def boxplot_summary(df: DataFrame, x: str | None, y: str | None) -> DataFrame:
    """min, Q1, median, Q3, max and count by x, by hinges that leave out the median of an odd number.

    A group with fewer than two numbers fails the whole call.
    """
    if not x or x not in df.columns:
        raise TransformError("missing_xField")
    if not y or y not in df.columns:
        raise TransformError("missing_yField")
    if x in STATS:
        raise TransformError("xField_conflicts_with_stat_fields")
    rows = df.filter(~is_blank(F.col(x))).select(_key(df, x).alias(x), to_number(F.col(y)).alias("_y")).filter(F.col("_y").isNotNull())
    short = rows.groupBy(x).count().filter("count < 2").select(x).limit(1).collect()  # no values are moved for this
    if short:
        raise TransformError(f"insufficient_samples_{short[0][0]}")
    by = Window.partitionBy(x)
    ranked = rows.withColumn("_k", F.row_number().over(by.orderBy("_y"))).withColumn("_n", F.count("*").over(by))
    half = F.floor(F.col("_n") / 2)
    stretches = {"Q1": (F.lit(1), half), "median": (F.lit(1), F.col("_n")), "Q3": (F.col("_n") - half + 1, half)}

    def middle(start: Column, length: Column) -> Column:
        at = lambda k: F.max(F.when(F.col("_k") == k, F.col("_y")))
        return (at(start + F.floor((length - 1) / 2)) + at(start + F.floor(length / 2))) / 2

    return ranked.groupBy(x).agg(F.min("_y").alias("min"), *[middle(*s).alias(c) for c, s in stretches.items()], F.max("_y").alias("max")).select(x, *STATS)


def matrix_aggregate(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Sums of value by x and y, one row per cell that holds a number."""
    if not value or value not in df.columns:
        raise TransformError("missing_valueField")
    if x not in df.columns:
        raise TransformError("missing_xField")
    if y not in df.columns:
        raise TransformError("missing_yField")
    if len({x, y, value}) < 3:
        raise TransformError("field_conflict")
    rows = df.filter(~is_blank(F.col(x)) & ~is_blank(F.col(y))).select(_key(df, x).alias(x), _key(df, y).alias(y), to_number(F.col(value)).alias(value))
    return rows.filter(F.col(value).isNotNull()).groupBy(x, y).agg(F.sum(value).alias(value))


def transform(df: DataFrame, kind: str, **fields) -> DataFrame:
    """Runs a transform by its name; those that are only named raise unsupported_transform_*."""
    if kind == "none":
        return df
    known = {"group_by_sum": group_by_sum, "boxplot_summary": boxplot_summary, "matrix_aggregate": matrix_aggregate}
    if kind not in known:
        raise TransformError(f"unsupported_transform_{kind}")
    return known[kind](df, **fields)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: round_stored(F.col(c), 2) for c in columns})


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with values as text, some blank or no numbers: what results look like."""
    odd = F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 11 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string"))
    segment = F.when(F.col("c_custkey") % 13 == 0, F.lit(None)).when(F.col("c_custkey") % 17 == 0, "").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", segment.alias("segment"), odd.alias("points"), "c_acctbal")


_MIXED_SQL = """
WITH mixed AS (
  SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN '' ELSE c_mktsegment END AS segment,
         CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS VARCHAR) END AS points, c_acctbal
  FROM customer
)
"""
register("X1_none", lambda spark, d: transform(table(spark, d, "nation"), "none"), "SELECT * FROM nation")
register("X2_group_by_sum", lambda spark, d: transform(_mixed(spark, d), "group_by_sum", x="segment", ys=["points"]),
         _MIXED_SQL + "SELECT segment, sum(try_cast(points AS DOUBLE)) AS points FROM mixed WHERE segment <> '' AND try_cast(points AS DOUBLE) IS NOT NULL GROUP BY segment")
register("X2_group_by_numeric_key", lambda spark, d: transform(_mixed(spark, d), "group_by_sum", x="c_nationkey", ys=["points", "points"]),
         _MIXED_SQL + "SELECT CAST(c_nationkey AS VARCHAR) AS c_nationkey, sum(try_cast(points AS DOUBLE)) AS points FROM mixed WHERE try_cast(points AS DOUBLE) IS NOT NULL GROUP BY 1")
register("X3_boxplot_summary", lambda spark, d: _rounded(transform(_mixed(spark, d), "boxplot_summary", x="segment", y="c_acctbal"), *STATS), _MIXED_SQL + """
, ordered AS (SELECT segment, list_sort(list(c_acctbal)) AS v, count(*) AS n FROM mixed WHERE segment <> '' GROUP BY segment)
SELECT segment, round(v[1], 2) AS min, round(median_of(v[1 : n // 2]), 2) AS "Q1", round(median_of(v), 2) AS median,
       round(median_of(v[n - n // 2 + 1 : n]), 2) AS "Q3", round(v[n], 2) AS max FROM ordered
""".replace("median_of(", "list_aggregate(").replace("n // 2]),", "n // 2], 'median'),").replace("list_aggregate(v)", "list_aggregate(v, 'median')").replace(": n]),", ": n], 'median'),"))
register("X4_matrix_aggregate", lambda spark, d: transform(table(spark, d, "lineitem"), "matrix_aggregate", x="l_returnflag", y="l_linestatus", value="l_quantity"),
         "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2")
