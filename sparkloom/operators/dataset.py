"""What a result set looks like: kinds of its columns, keys, completeness, archetype."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import distinct_counts, is_blank, to_number
from ..registry import register
from ..sources.tables import table

_YEAR_NAME = r"(?i)year|年"


def is_date_text(value: Column) -> Column:
    """A text that stands for a point in time: an ISO date or time, a month or a quarter."""
    text = value.cast("string")
    return text.rlike(r"^\d{4}-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?)?$") | text.rlike(r"^(\d{4}[- ]?)?Q[1-4]$") | text.rlike("^(\\d{4}年)?\\d{1,2}月$")


def fields(df: DataFrame) -> DataFrame:
    """Per column: kind (numeric, temporal, text or empty), filled, distinct.

    A column is numeric if all its values that aren't blank are numbers; temporal if all are dates as text, or years.
    """
    made = []
    for c in df.columns:
        v, full = F.col(f"`{c}`"), ~is_blank(F.col(f"`{c}`"))
        number = to_number(v)
        year = (number >= 1900) & (number <= 2100) & (number == F.floor(number))
        made.append(F.struct(
            F.lit(c).alias("field"), F.count_if(full).alias("filled"),
            F.coalesce(F.bool_and(F.when(full, number.isNotNull())), F.lit(False)).alias("numeric"),
            (F.coalesce(F.bool_and(F.when(full, is_date_text(v))), F.lit(False)) | (F.coalesce(F.bool_and(F.when(full, F.coalesce(year, F.lit(False)))), F.lit(False)))).alias("temporal")).alias(f"_{len(made)}"))
    wide = df.agg(*made).select(F.inline(F.array(*[f"_{i}" for i in range(len(made))])))
    kind = F.when(F.col("filled") == 0, "empty").when(F.col("temporal"), "temporal").when(F.col("numeric"), "numeric").otherwise("text")
    found = distinct_counts(df, df.columns, skip_blank=True).withColumnRenamed("column", "field")
    return wide.join(found, "field", "left").select("field", kind.alias("kind"), "filled", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"))


def duplicate_keys(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """Whether rows with all dimensions repeat them."""
    rows = df
    for c in dimensions:
        rows = rows.filter(~is_blank(F.col(c)))
    return rows.groupBy(*dimensions).agg(F.count("*").alias("n")).agg(F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("duplicates"))


def pair_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs over the product of both cardinalities, at most 1."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    both = F.when(~is_blank(F.col(a)) & ~is_blank(F.col(b)), F.struct(a, b))
    return df.agg(F.count_distinct(both).alias("p"), F.count_distinct(text(a)).alias("x"), F.count_distinct(text(b)).alias("y")).select(F.round(F.least(F.lit(1.0), F.try_divide("p", F.col("x") * F.col("y"))), 6).alias("ratio"))


def grouped_samples(df: DataFrame, x: str, y: str) -> DataFrame:
    """Groups, the smallest one, and whether five-number summaries make sense: two groups of two at least."""
    got = df.filter(~is_blank(F.col(x)) & to_number(F.col(y)).isNotNull()).groupBy(x).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.min("n").alias("least"))
    return got.withColumn("eligible", (F.col("groups") >= 2) & (F.col("least") >= 2))


def part_to_whole(df: DataFrame, x: str, y: str) -> DataFrame:
    """Total, negatives, categories, and whether shares make sense: none negative, a positive total, 2 to 12 categories."""
    got = df.agg(F.round(F.sum(to_number(F.col(y))), 2).alias("total"), F.coalesce(F.bool_or(to_number(F.col(y)) < 0), F.lit(False)).alias("negative"), F.count_distinct(x).alias("categories"))
    return got.withColumn("eligible", ~F.col("negative") & (F.col("total") > 0) & F.col("categories").between(2, 12))


def series_completeness(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Mean over entities of their distinct times among all."""
    each = df.groupBy(entity).agg(F.count_distinct(time).alias("n"))
    whole = df.agg(F.count_distinct(time).alias("all"))
    return each.join(F.broadcast(whole)).agg(F.round(F.avg(F.col("n") / F.col("all")), 6).alias("completeness"))


def entity_occurrences(df: DataFrame, entity: str) -> DataFrame:
    """Distinct entities and the most rows of one."""
    return df.filter(~is_blank(F.col(entity))).groupBy(entity).agg(F.count("*").alias("n")).agg(F.count("*").alias("entities"), F.max("n").alias("most"))


def chart_worthy(df: DataFrame) -> DataFrame:
    """Whether at least half the second column's values are numbers."""
    return df.agg((F.coalesce(F.avg(to_number(F.col(f"`{df.columns[1]}`")).isNotNull().cast("int")), F.lit(0.0)) >= 0.5).alias("worthy"))


def archetype(t: dict) -> str:
    """The kind of a result from its traits, by the first rule that holds.

    Traits: rows, measures, dimensions, times, identifiers (numbers of columns), heterogeneous and detail (confidences),
    aggregated, entity (whether there is one), entities, time_points, multi_series, matrix, duplicates.
    """
    rules = [
        ("empty", t["rows"] == 0), ("single_value", t["rows"] == 1 and t["measures"] == 1), ("single_row_multi_measure", t["rows"] == 1 and t["measures"] > 1),
        ("heterogeneous_metric_rows", t["heterogeneous"] >= 0.6),
        ("detail_rows", t["identifiers"] > 0 or not t["aggregated"] and (t["measures"] > 1 or t["detail"] >= 0.5)),
        ("multi_series_temporal", t["entity"] and t["times"] and t["measures"] == 1 and min(t["entities"], t["time_points"]) >= 2 and t["multi_series"] and t["aggregated"]),
        ("categorical_matrix", t["dimensions"] >= 2 and t["measures"] == 1 and t["matrix"]),
        ("numeric_relationship", not t["dimensions"] and not t["times"] and t["measures"] >= 2),
        ("temporal_series", t["times"] and t["time_points"] >= 2 and t["measures"]),
        ("categorical_series", t["dimensions"] and t["measures"] and not t["duplicates"]), ("detail_rows", t["detail"] >= 0.5),
    ]
    return next((name for name, holds in rules if holds), "unknown")


def _mixed(s: SparkSession, d: str) -> DataFrame:
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    return o.select(
        F.when(k % 5 > 0, F.col("o_custkey").cast("string")).otherwise("").alias("number"), F.when(k % 50 == 0, "12d").otherwise(k.cast("string")).alias("nearly"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("label"), F.lit("").alias("blank"))


_F = "WITH f AS (SELECT CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey AS VARCHAR) END AS number, CASE WHEN o_orderkey % 50 = 0 THEN '12d' ELSE CAST(o_orderkey AS VARCHAR) END AS nearly, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS y, o_orderpriority AS label FROM orders) "
register("C1_blank", lambda s, d: _mixed(s, d).agg(F.count_if(is_blank(F.col("number"))).alias("number"), F.count_if(is_blank(F.col("blank"))).alias("blank")), _F + "SELECT count(*) FILTER (number IS NULL) AS number, count(*) AS blank FROM f")
register("C2_numbers", lambda s, d: _mixed(s, d).agg(F.count(to_number(F.col("number"))).alias("number"), F.count(to_number(F.col("nearly"))).alias("nearly"), F.count(to_number(F.col("label"))).alias("label")), _F + "SELECT count(number) AS number, count(*) FILTER (nearly <> '12d') AS nearly, 0::BIGINT AS label FROM f")
register("C10_fields", lambda s, d: fields(_mixed(s, d)), _F + """
SELECT 'number' AS field, 'numeric' AS kind, count(number) AS filled, count(DISTINCT number) AS "distinct" FROM f UNION ALL SELECT 'nearly', 'text', count(*), count(DISTINCT nearly) FROM f UNION ALL
SELECT 'day', 'temporal', count(*), count(DISTINCT day) FROM f UNION ALL SELECT 'year', 'temporal', count(*), count(DISTINCT y) FROM f UNION ALL SELECT 'label', 'text', count(*), count(DISTINCT label) FROM f UNION ALL SELECT 'blank', 'empty', 0, 0""")
register("C7_entity_occurrences", lambda s, d: entity_occurrences(table(s, d, "events"), "user_id"), "SELECT count(*) AS entities, max(n) AS most FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
register("C11_duplicate_keys", lambda s, d: duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT bool_or(n > 1) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
register("C12_pair_ratio", lambda s, d: pair_ratio(table(s, d, "orders"), "o_custkey", "o_orderpriority"), "SELECT round(least(1.0::DOUBLE, count(DISTINCT (o_custkey, o_orderpriority)) / (count(DISTINCT o_custkey) * count(DISTINCT o_orderpriority))), 6) AS ratio FROM orders")
register("C13_grouped_samples", lambda s, d: grouped_samples(table(s, d, "customer"), "c_mktsegment", "c_acctbal"), "SELECT count(*) AS groups, min(n) AS least, count(*) >= 2 AND min(n) >= 2 AS eligible FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)")
register("C14_part_to_whole", lambda s, d: part_to_whole(table(s, d, "orders"), "o_orderpriority", "o_totalprice"), "SELECT round(sum(o_totalprice), 2) AS total, bool_or(o_totalprice < 0) AS negative, count(DISTINCT o_orderpriority) AS categories, NOT bool_or(o_totalprice < 0) AND sum(o_totalprice) > 0 AND count(DISTINCT o_orderpriority) BETWEEN 2 AND 12 AS eligible FROM orders")
register("C15_matrix", lambda s, d: pair_ratio(table(s, d, "orders"), "o_orderstatus", "o_orderpriority").select((F.col("ratio") >= 0.3).alias("eligible")), "SELECT count(DISTINCT (o_orderstatus, o_orderpriority)) / (count(DISTINCT o_orderstatus) * count(DISTINCT o_orderpriority)) >= 0.3 AS eligible FROM orders")
register("C16_completeness", lambda s, d: series_completeness(table(s, d, "events").withColumn("day", F.to_date("ts")), "user_id", "day"), "SELECT round(avg(n / (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events)), 6) AS completeness FROM (SELECT count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY user_id)")
register("C21_measure_totals", lambda s, d: table(s, d, "customer").agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.bool_or(F.col("c_acctbal") < 0).alias("negative")), "SELECT round(sum(c_acctbal), 2) AS total, bool_or(c_acctbal < 0) AS negative FROM customer")
register("C22_cardinality", lambda s, d: table(s, d, "customer").agg(F.count_distinct("c_mktsegment").alias("categories")), "SELECT count(DISTINCT c_mktsegment) AS categories FROM customer")
register("C23_chart_worthy", lambda s, d: chart_worthy(_mixed(s, d).select("label", "number")), _F + "SELECT count(number) / count(*) >= 0.5 AS worthy FROM f")
