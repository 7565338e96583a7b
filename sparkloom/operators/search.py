"""Ranking of a catalogue's tables for a question: names, comments, columns, domains and intent rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import register
from ..sources.tables import table

#: Marks that are left out when names and comments are compared.
_MARKS = r"[\s\-_（）()【】\[\]：:，,。.;；/\\]+"
#: Points of a table by its name, its comment, its best column (name, then comment) and its domain.
NAME_POINTS = {"exact": 10000, "inside": 820, "like": 420, "from": 0.72}
COMMENT_POINTS = {"exact": 3600, "inside": 2300, "like": 1350, "from": 0.56}
COLUMN_NAME_POINTS = {"exact": 2850, "inside": 720, "least": 3}
COLUMN_COMMENT_POINTS = {"exact": 2450, "inside": 1420, "like": 760, "from": 0.76, "least": 2}
DOMAIN_POINTS = {"same": 6200, "other": -2200}
#: Fixed value: columns of a table that are told to have matched.
MATCHED = 8

#: How alike two texts are, 0 to 1.
Likeness = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Intent:
    """A rule: points for tables that match, if the question does. Patterns are regular expressions; "" matches all.

    question is searched in the compacted question and `unless` may not be; table and comment are searched in the table's.
    """

    name: str
    points: int
    question: str = ""
    unless: str = ""
    table: str = ""
    comment: str = ""


def lowered(text: Column) -> Column:
    """A name as it is compared: trimmed, in lower case."""
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def compacted(text: Column) -> Column:
    """A comment as it is compared: in lower case, without blanks and marks."""
    return F.regexp_replace(lowered(text), _MARKS, "")


def _within(a: Column, b: Column) -> Column:
    """Whether one text is part of the other; the first may not be empty."""
    return (a != "") & (F.contains(b, a) | F.contains(a, b))


def _points(q: Column, text: Column, points: dict, like: Likeness | None, exact: Column) -> Column:
    near = like(q, text) if like else F.lit(0.0)
    inside = _within(q, text) & (F.length(q) >= points.get("least", 0))
    out = F.when(exact, points["exact"]).when(inside, points["inside"])
    if like and "like" in points:
        out = out.when(near >= points["from"], F.floor(points["like"] * near).cast("int"))
    return out.otherwise(0)


def name_points(question: Column, name: Column, like: Likeness | None = None) -> Column:
    """Points of a table's name."""
    q, name = lowered(question), lowered(name)
    return _points(q, name, NAME_POINTS, like, q == name)


def comment_points(question: Column, comment: Column, like: Likeness | None = None) -> Column:
    """Points of a table's comment."""
    q, comment = compacted(question), compacted(comment)
    return _points(q, comment, COMMENT_POINTS, like, (q == comment) & (q != ""))


def column_points(question: Column, name: Column, comment: Column, like: Likeness | None = None) -> Column:
    """Points of one column: those of its name and those of its comment."""
    qn, qc, name, comment = lowered(question), compacted(question), lowered(name), compacted(comment)
    return _points(qn, name, COLUMN_NAME_POINTS, None, qn == name) + _points(qc, comment, COLUMN_COMMENT_POINTS, like, (qc == comment) & (qc != ""))


def best_columns(question: Column, columns: DataFrame, like: Likeness | None = None) -> DataFrame:
    """table, points of its best column, exact (whether that has the question's name), matched: names of columns with
    points, exact names first, then exact comments, then by name."""
    q, c = lowered(question), compacted(question)
    scored = columns.select("table", "column", column_points(question, F.col("column"), F.col("comment"), like).alias("points"),
                            (lowered(F.col("column")) == q).alias("exact"), ((compacted(F.col("comment")) == c) & (c != "")).alias("said")).filter("points > 0")
    by = Window.partitionBy("table").orderBy(F.desc("exact"), F.desc("said"), "column")
    ranked = scored.withColumn("k", F.row_number().over(by))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= MATCHED, F.struct("k", "column")))), lambda x: x["column"])
    return ranked.groupBy("table").agg(F.max("points").alias("points"), F.max_by("exact", F.struct("points", -F.col("k"))).alias("exact"), names.alias("matched"))


def domain_points(question: Column, domain: Column, keywords: dict[str, Iterable[str]]) -> Column:
    """Points of a table's domain, when the question has a keyword of any domain."""
    q = compacted(question)
    named = {d: F.greatest(*[F.contains(q, F.lit(w.lower())) for w in words], F.lit(False)) for d, words in keywords.items()}
    anyone = F.greatest(*named.values(), F.lit(False))
    own = F.greatest(*[(domain == d) & x for d, x in named.items()], F.lit(False))
    return F.when(own, DOMAIN_POINTS["same"]).when(anyone & (F.coalesce(domain, F.lit("")) != ""), DOMAIN_POINTS["other"]).otherwise(0)


def intent_points(question: Column, name: Column, comment: Column, rules: Iterable[Intent]) -> Column:
    """The sum of all rules' points that hold."""
    q, name, comment = compacted(question), lowered(name), compacted(comment)
    out = F.lit(0)
    for r in rules:
        holds = q.rlike(r.question) & name.rlike(r.table) & comment.rlike(r.comment)
        out = out + F.when(holds & ~q.rlike(r.unless) if r.unless else holds, r.points).otherwise(0)
    return out


def risk(family: Column, exact_name: Column, exact_comment: Column, exact_column: Column) -> Column:
    """How likely a table is taken for another one of its family."""
    return F.when(F.coalesce(family, F.lit("")) == "", "low").when(exact_name, "low").when(exact_comment | exact_column, "medium").otherwise("high")


def rank_tables(tables: DataFrame, columns: DataFrame, question: str, keywords: dict[str, Iterable[str]] | None = None, rules: Iterable[Intent] = (), like: Likeness | None = None, top: int = 10) -> DataFrame:
    """The best tables for a question: table, score, exact (its name), matched columns, risk.

    Needs tables (table, comment, domain, family) and columns (table, column, comment). The score is the sum of all
    points, 0 at least; tables without points go. Order: score, exact names, short names, name.
    """
    q = F.lit(question)
    found = best_columns(q, columns, like).select("table", F.col("points").alias("_column"), F.col("exact").alias("_exact"), "matched")
    exact, said = lowered(q) == lowered(F.col("table")), (compacted(q) == compacted(F.col("comment"))) & (compacted(q) != "")
    total = (name_points(q, F.col("table"), like) + comment_points(q, F.col("comment"), like) + F.coalesce("_column", F.lit(0))
             + domain_points(q, F.col("domain"), keywords or {}) + intent_points(q, F.col("table"), F.col("comment"), rules))
    rows = tables.join(found, "table", "left").select(
        "table", F.greatest(total, F.lit(0)).cast("long").alias("score"), F.coalesce(exact, F.lit(False)).alias("exact"), F.coalesce("matched", F.array().cast("array<string>")).alias("matched"),
        risk(F.col("family"), exact, said, F.coalesce("_exact", F.lit(False))).alias("risk"))
    return rows.filter("score > 0").orderBy(F.desc("score"), F.desc("exact"), F.length("table"), "table").limit(top)


def context_text(ranked: DataFrame, columns: DataFrame, full: int = 3, short: int = 20) -> DataFrame:
    """rank, table, text: a line for each ranked table with its columns: all for the first `full` tables, else the first
    `short` ones by name. ranked is small: at most the top tables of rank_tables."""
    by = Window.orderBy(F.desc("score"), F.desc("exact"), F.length("table"), "table")
    ranked = ranked.withColumn("rank", F.row_number().over(by))
    own = columns.join(F.broadcast(ranked.select("table", "rank")), "table").withColumn("k", F.row_number().over(Window.partitionBy("table").orderBy("column")))
    told = own.filter((F.col("rank") <= full) | (F.col("k") <= short)).groupBy("table").agg(F.array_join(F.array_sort(F.collect_list("column")), ", ").alias("names"))
    return ranked.join(told, "table", "left").select("rank", "table", F.concat(F.lit("table "), "table", F.lit(" ["), "risk", F.lit("]: "), F.coalesce("names", F.lit(""))).alias("text"))


# queries: parts stand for the tables of a catalogue
KEYWORDS = {"ECONOMY": ("cheap", "economy"), "LARGE": ("large", "big"), "PROMO": ("promo",)}
RULES = (
    Intent("ring records", 1800, question="ring", table="_ring_"), Intent("not the small ones", -600, question="ring", unless="small", table="^small_"),
    Intent("by day", 1450, question="day|daily", comment="promo"), Intent("widgets of brands", 700, question="brand", unless="ring|bolt", table="widget", comment="large|medium"),
)
_QUESTION = "Small ring"


def _tables(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 50 == 0, F.col("p_name")).otherwise(F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")))
    return part.select(name.alias("table"), F.concat(F.lower("p_type"), F.lit(" "), "p_name").alias("comment"), F.col("p_type").alias("domain"),
                       F.when(F.col("p_size") % 2 == 0, F.lower("p_brand")).otherwise("").alias("family"), "p_partkey").groupBy("table").agg(*(F.min_by(c, "p_partkey").alias(c) for c in ("comment", "domain", "family")))


def _columns(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 50 == 0, F.col("p_name")).otherwise(F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")))
    pairs = F.array(F.struct(F.lit("size").alias("column"), F.concat(F.lit("size of "), "p_name").alias("comment")), F.struct(F.lower("p_brand").alias("column"), F.lower("p_type").alias("comment")),
                    F.struct(F.substring_index("p_name", " ", -1).alias("column"), F.when(F.col("p_size") == 7, F.lit("small-ring")).alias("comment")))
    return part.select(name.alias("table"), F.inline(pairs)).distinct()


_SQL = r"""
WITH tables AS (
  SELECT DISTINCT ON ("table") * FROM (
    SELECT CASE WHEN p_partkey % 50 = 0 THEN p_name ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS "table", lower(p_type) || ' ' || p_name AS comment, p_type AS domain,
           CASE WHEN p_size % 2 = 0 THEN lower(p_brand) ELSE '' END AS family, p_partkey FROM part) ORDER BY "table", p_partkey
), columns AS (
  SELECT DISTINCT CASE WHEN p_partkey % 50 = 0 THEN p_name ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS "table", unnest(['size', lower(p_brand), split_part(p_name, ' ', -1)]) AS "column",
         unnest(['size of ' || p_name, lower(p_type), CASE WHEN p_size = 7 THEN 'small-ring' END]) AS comment FROM part
), points AS (
  SELECT "table", "column", CASE WHEN "column" = 'small ring' THEN 2850 WHEN contains('small ring', "column") OR contains("column", 'small ring') THEN 720 ELSE 0 END
       + CASE WHEN x = 'smallring' THEN 2450 WHEN contains('smallring', x) OR contains(x, 'smallring') THEN 1420 ELSE 0 END AS points, x = 'smallring' AS said
  FROM (SELECT *, replace(replace(coalesce(comment, ''), ' ', ''), '-', '') AS x FROM columns)
), best AS (
  SELECT "table", max(points) AS points, list_slice(list("column" ORDER BY said DESC, "column"), 1, 8) AS matched FROM points WHERE points > 0 GROUP BY 1
), parts AS (
  SELECT t.*, t."table" = 'small ring' AS exact, CASE WHEN t."table" = 'small ring' THEN 10000 WHEN contains(t."table", 'small ring') OR contains('small ring', t."table") THEN 820 ELSE 0 END AS by_name,
         CASE WHEN contains(replace(t.comment, ' ', ''), 'smallring') OR contains('smallring', replace(t.comment, ' ', '')) THEN 2300 ELSE 0 END AS by_comment,
         coalesce(b.points, 0) AS by_column, coalesce(b.matched, []) AS matched
  FROM tables t LEFT JOIN best b ON t."table" = b."table"
)
"""
_q = F.lit
register("M3_table_name_points", lambda spark, d: _tables(spark, d).select("table", name_points(_q("ring_"), F.col("table")).cast("long").alias("points")),
         _SQL + """SELECT "table", CAST(CASE WHEN "table" = 'ring_' THEN 10000 WHEN contains("table", 'ring_') OR contains('ring_', "table") THEN 820 ELSE 0 END AS BIGINT) AS points FROM tables""")
register("M4_table_comment_points", lambda spark, d: _tables(spark, d).select("table", comment_points(_q("ECONOMY: small ring."), F.col("comment")).cast("long").alias("points")),
         _SQL + """SELECT "table", CAST(CASE WHEN comment = 'economy small ring' THEN 3600 ELSE 0 END AS BIGINT) AS points FROM tables""")
register("M5_best_column", lambda spark, d: best_columns(_q(_QUESTION), _columns(spark, d)).select("table", F.col("points").cast("long").alias("points"), F.array_join("matched", ",").alias("matched")),
         _SQL + """SELECT "table", CAST(points AS BIGINT) AS points, array_to_string(matched, ',') AS matched FROM best""")
register("M3_exact_names", lambda spark, d: _tables(spark, d).select("table", name_points(_q(" COLD Widget "), F.col("table")).cast("long").alias("points")),
         _SQL + """SELECT "table", CAST(CASE WHEN "table" = 'cold widget' THEN 10000 WHEN contains("table", 'cold widget') OR contains('cold widget', "table") THEN 820 ELSE 0 END AS BIGINT) AS points FROM tables""")
register("M5_exact_columns", lambda spark, d: best_columns(_q("Ring"), _columns(spark, d)).select("table", F.col("points").cast("long").alias("points"), "exact", F.array_join("matched", ",").alias("matched")), _SQL + """
, scored AS (
  SELECT "table", "column", "column" = 'ring' AS exact, CASE WHEN "column" = 'ring' THEN 2850 WHEN contains("column", 'ring') OR contains('ring', "column") THEN 720 ELSE 0 END
       + CASE WHEN x = 'ring' THEN 2450 WHEN contains(x, 'ring') OR contains('ring', x) THEN 1420 ELSE 0 END AS points, x = 'ring' AS said
  FROM (SELECT *, replace(replace(coalesce(comment, ''), ' ', ''), '-', '') AS x FROM columns)
)
SELECT "table", CAST(max(points) AS BIGINT) AS points, arg_max(exact, points * 10 + exact::INT) AS exact, array_to_string(list_slice(list("column" ORDER BY exact DESC, said DESC, "column"), 1, 8), ',') AS matched
FROM scored WHERE points > 0 GROUP BY 1""")
register("M6_domain_points", lambda spark, d: _tables(spark, d).select("table", domain_points(_q("a big ring"), F.col("domain"), KEYWORDS).cast("long").alias("points")),
         _SQL + """SELECT "table", CAST(CASE WHEN domain = 'LARGE' THEN 6200 ELSE -2200 END AS BIGINT) AS points FROM tables""")
register("M7_intent_points", lambda spark, d: _tables(spark, d).select("table", intent_points(_q("rings by brand and day"), F.col("table"), F.col("comment"), RULES).cast("long").alias("points")), _SQL + """
SELECT "table", CAST(CASE WHEN contains("table", '_ring_') THEN 1800 ELSE 0 END - CASE WHEN starts_with("table", 'small_') THEN 600 ELSE 0 END
     + CASE WHEN starts_with(comment, 'promo') THEN 1450 ELSE 0 END AS BIGINT) AS points FROM tables""")
register("M9_risk", lambda spark, d: _tables(spark, d).select("table", risk(F.col("family"), F.endswith("table", F.lit("1")), F.col("domain") == "PROMO", F.lit(False)).alias("risk")), _SQL + """
SELECT "table", CASE WHEN family = '' OR "table" LIKE '%1' THEN 'low' WHEN domain = 'PROMO' THEN 'medium' ELSE 'high' END AS risk FROM tables""")
register("M1_rank_tables", lambda spark, d: rank_tables(_tables(spark, d), _columns(spark, d), _QUESTION, KEYWORDS, RULES, top=10).withColumn("matched", F.array_join("matched", ",")), _SQL + """
SELECT "table", CAST(greatest(score, 0) AS BIGINT) AS score, exact, array_to_string(matched, ',') AS matched, CASE WHEN family = '' OR exact THEN 'low' ELSE 'high' END AS risk FROM (
  SELECT *, by_name + by_comment + by_column + CASE WHEN contains("table", '_ring_') THEN 1800 ELSE 0 END AS score FROM parts)
WHERE score > 0 ORDER BY score DESC, exact DESC, length("table"), "table" LIMIT 10""")
register("M12_context", lambda spark, d: context_text(rank_tables(_tables(spark, d), _columns(spark, d), _QUESTION, KEYWORDS, RULES, top=10), _columns(spark, d), full=3, short=2), _SQL + """
, ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, exact DESC, length("table"), "table") AS rank FROM (SELECT *, by_name + by_comment + by_column + CASE WHEN contains("table", '_ring_') THEN 1800 ELSE 0 END AS score FROM parts) WHERE score > 0
), told AS (
  SELECT "table", "column", row_number() OVER (PARTITION BY "table" ORDER BY "column") AS k FROM columns
)
SELECT CAST(r.rank AS INTEGER) AS rank, r."table", 'table ' || r."table" || ' [' || CASE WHEN any_value(family) = '' OR bool_or(exact) THEN 'low' ELSE 'high' END || ']: ' || string_agg(t."column", ', ' ORDER BY t."column") AS text
FROM ranked r JOIN told t ON r."table" = t."table" AND (r.rank <= 3 OR t.k <= 2) WHERE r.rank <= 10 GROUP BY 1, 2""")
