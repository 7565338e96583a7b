"""Texts of a catalogue: sample queries of tables, semantics filled from profiles, keys read from DDL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import normal_text
from ..plans import guard
from ..registry import register
from ..sources.tables import table
from .profiling import sensitive

#: Columns and rows of a sample query, and sample queries of a source at most.
SAMPLE_COLUMNS, SAMPLE_ROWS, SAMPLES = 5, 5, 30
#: What stands where a profile says nothing.
NO_DOMAIN, NO_GRAIN, NO_ROLE, OF_TABLE = "其他业务", "待语义确认", "业务表", " 业务数据"


def sample_queries(columns: DataFrame, profiles: DataFrame, source: str) -> DataFrame:
    """sample_id, table, question, sql: one query for each table, of its first columns that may be shown, latest rows first.

    columns: table, column, type, ordinal_position, table_comment. profiles: table, time_column (or null or ""), failed.
    Tables whose profile failed or that have no column to show have none; a time column comes first."""
    own = columns.join(profiles.select("table", "time_column", "failed"), "table", "left").filter(~F.coalesce("failed", F.lit(False)))
    shown = own.filter(~sensitive(F.col("column")) & ~F.contains(F.lower("type"), F.lit("geometry")))
    listed = shown.groupBy("table").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal_position", "column"))), lambda x: x["column"]).alias("names"), F.max("table_comment").alias("comment"), F.max(F.nullif("time_column", F.lit(""))).alias("time"))
    first = F.slice("names", 1, SAMPLE_COLUMNS)
    picked = F.when(F.col("time").isNotNull() & ~F.array_contains(first, F.col("time")), F.concat(F.array("time"), F.slice("names", 1, SAMPLE_COLUMNS - 1))).otherwise(first)
    quoted = lambda c: F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))
    order = F.when(F.col("time").isNotNull(), F.concat(F.lit(" ORDER BY "), quoted(F.col("time")), F.lit(" DESC"))).otherwise("")
    text = F.concat(F.lit("SELECT "), F.array_join(F.transform(picked, quoted), ", "), F.lit(" FROM "), quoted(F.col("table")), order, F.lit(f" LIMIT {SAMPLE_ROWS}"))
    label = F.coalesce(F.nullif("comment", F.lit("")), F.col("table"))
    asked = F.when(F.col("time").isNotNull(), F.concat(F.lit("查看"), label, F.lit("最近5条记录"))).otherwise(F.concat(F.lit("查看"), label, F.lit("的5条示例记录")))
    rows = listed.select("table", asked.alias("question"), text.alias("sql"))
    return rows.select(F.concat(F.lit("auto_"), F.substring(F.sha2(F.concat_ws("|", F.lit(source), "question", "sql"), 256), 1, 24)).alias("sample_id"), "table", "question", "sql")


def verified(spark: SparkSession, samples: DataFrame, most: int = SAMPLES, **rules) -> list[str]:
    """Ids of the first samples, by table, that pass the guard without a warning and run. At most `most` are tried, each for a few rows."""
    found = []
    for row in samples.orderBy("table").limit(most).collect():
        if guard.check(spark, row["sql"], candidates={row["table"]}, **rules).severity == "ok":
            try:
                spark.sql(row["sql"]).limit(SAMPLE_ROWS).collect()
                found.append(row["sample_id"])
            except PySparkException:  # a query that fails is no sample
                continue
    return found


def filled_semantics(columns: DataFrame, profiles: DataFrame, description: str = "", display: str = "", suggested: DataFrame | None = None) -> DataFrame:
    """columns with domain, summary, grain, time_column, role of their table, filled where profiles say nothing.

    profiles: table, comment, grain, time_column, role. suggested: table, time_column; taken only if the table has that column."""
    text = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    p = profiles.select("table", text("comment").alias("_comment"), text("grain").alias("_grain"), text("time_column").alias("_time"), text("role").alias("_role"))
    out = columns.join(p, "table", "left")
    if suggested is not None:
        real = suggested.select("table", F.col("time_column").alias("column")).join(columns.select("table", "column").distinct(), ["table", "column"], "left_semi").groupBy("table").agg(F.min("column").alias("_suggested"))
        out = out.join(real, "table", "left").withColumn("_time", F.coalesce("_suggested", "_time"))
    domain = F.coalesce("_comment", F.lit(description or display or NO_DOMAIN))
    return out.select(*columns.columns, domain.alias("domain"), F.coalesce("_comment", F.concat("table", F.lit(OF_TABLE))).alias("summary"), F.coalesce("_grain", F.lit(NO_GRAIN)).alias("grain"), F.coalesce("_time", F.lit("")).alias("time_column"), F.coalesce("_role", F.lit(NO_ROLE)).alias("role"))


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r'^["`\[]+|["`\]]+$', "")


def _held(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), the value being made once: as it stands, each use within a function of arrays would make it again."""
    return F.get(F.transform(F.array(value), make), 0)


def ddl_keys(sql: Column) -> Column:
    """What a CREATE TABLE text says, or null: table, columns (name, type), primary_key, indexes (name, unique, columns).

    Comments are left out first. Keys may stand beside a column or as clauses of their own; CREATE INDEX texts behind the
    table's count too. Names lose their quotes and schemas."""
    return _held(normal_text(sql), _keys_of)


def _keys_of(text: Column) -> Column:
    head = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?([^\s(]+)\s*\((.*?)\)\s*(?:;|\z|comment|engine|using)"
    # commas within brackets or quotes part nothing
    parts = F.transform(F.regexp_extract_all(F.regexp_extract(text, head, 2), F.lit(r"(?s)((?:'(?:[^']|'')*'|\((?:[^()']|'(?:[^']|'')*'|\([^()]*\))*\)|[^,'()])+)"), F.lit(1)), lambda x: F.trim(x))
    return F.when(text.rlike(head), _held(parts, lambda parts: _keys_of_parts(text, head, parts)))


def _keys_of_parts(text: Column, head: str, parts: Column) -> Column:
    clause = r"(?i)^(?:constraint\s+\S+\s+)?(?:primary\s+key|unique(?:\s+(?:key|index))?|key|index|foreign\s+key|check)\b"
    names = lambda x: F.transform(F.split(x, ","), lambda n: _bare(F.regexp_replace(F.trim(n), r"(?i)\s+(asc|desc)$|\(\d+\)", "")))
    own = F.filter(parts, lambda x: ~x.rlike(clause) & (x != ""))
    columns = F.transform(own, lambda x: F.struct(_bare(F.regexp_extract(x, r"^(\S+)", 1)).alias("name"), F.lower(F.regexp_extract(x, r"^\S+\s+(\w+(?:\s*\([^)]*\))?)", 1)).alias("type")))
    keyed = F.transform(F.filter(own, lambda x: x.rlike(r"(?i)\bprimary\s+key\b")), lambda x: _bare(F.regexp_extract(x, r"^(\S+)", 1)))
    primary = F.flatten(F.transform(F.filter(parts, lambda x: x.rlike(r"(?i)^(?:constraint\s+\S+\s+)?primary\s+key\b")), lambda x: names(F.regexp_extract(x, r"\((.*)\)", 1))))
    inner = F.transform(F.filter(parts, lambda x: x.rlike(r"(?i)^(?:constraint\s+\S+\s+)?(unique|key|index)\b")), lambda x: F.struct(
        _bare(F.coalesce(F.nullif(F.regexp_extract(x, r"(?i)^constraint\s+(\S+)", 1), F.lit("")), F.regexp_extract(x, r"(?i)^(?:unique\s+)?(?:key|index)\s+([^\s(]+)", 1))).alias("name"), x.rlike(r"(?i)^(?:constraint\s+\S+\s+)?unique").alias("unique"), names(F.regexp_extract(x, r"\(([^()]*(?:\(\d+\)[^()]*)*)\)", 1)).alias("columns")))
    after = F.transform(F.regexp_extract_all(text, F.lit(r"(?is)(create\s+(?:unique\s+)?index\s+[^;]*)"), F.lit(1)), lambda x: F.struct(
        _bare(F.regexp_extract(x, r"(?i)index\s+(?:if\s+not\s+exists\s+)?(\S+)", 1)).alias("name"), x.rlike(r"(?i)^create\s+unique").alias("unique"), names(F.regexp_extract(x, r"\(([^()]*(?:\(\d+\)[^()]*)*)\)", 1)).alias("columns")))
    return F.struct(_bare(F.substring_index(_bare(F.regexp_extract(text, head, 1)), ".", -1)).alias("table"), columns.alias("columns"), F.concat(primary, keyed).alias("primary_key"), F.concat(inner, after).alias("indexes"))


def _catalogue(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 8 == 0, "phone").when(k % 8 == 1, "geom").otherwise(F.concat(F.lit("c"), (k % 8).cast("string")))
    return table(s, d, "part").select(F.concat(F.lit("t"), F.floor(k / 8).cast("string")).alias("table"), name.alias("column"), F.when(k % 8 == 1, "geometry(Point)").otherwise("text").alias("type"), (9 - k % 8).cast("int").alias("ordinal_position"), F.when(F.floor(k / 8) % 2 == 0, "表").alias("table_comment"))


def _profiled(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(s, d, "part").filter("p_partkey % 8 = 0 AND p_partkey % 7 > 0").select(F.concat(F.lit("t"), F.floor(k / 8).cast("string")).alias("table"), F.when(F.floor(k / 8) % 3 == 0, "c2").when(F.floor(k / 8) % 3 == 1, "c7").alias("time_column"), (F.floor(k / 8) % 5 == 0).alias("failed"),
                                                                                  F.when(F.floor(k / 8) % 2 == 0, "水质").alias("comment"), F.lit("日").alias("grain"), F.when(F.floor(k / 8) % 4 == 0, "事实表").alias("role"))


_T = "WITH t AS (SELECT p_partkey // 8 AS k, max(p_partkey % 8) AS top, bool_or(p_partkey % 8 = 0 AND p_partkey % 7 > 0) AS known FROM part GROUP BY 1) "
register("D18_sample_queries", lambda s, d: sample_queries(_catalogue(s, d), _profiled(s, d), "src").select("sample_id", "table", "question", "sql"), _T + """
, n AS (SELECT k, CASE WHEN known AND k % 3 = 0 THEN 'c2' WHEN known AND k % 3 = 1 THEN 'c7' END AS tm FROM t WHERE top = 7 AND NOT (known AND k % 5 = 0)),
q AS (SELECT 't' || k AS t, '查看' || CASE WHEN k % 2 = 0 THEN '表' ELSE 't' || k END || CASE WHEN tm IS NULL THEN '的5条示例记录' ELSE '最近5条记录' END AS question,
  'SELECT ' || CASE WHEN tm = 'c2' THEN '`c2`, `c7`, `c6`, `c5`, `c4`' ELSE '`c7`, `c6`, `c5`, `c4`, `c3`' END || ' FROM `t' || k || '`' || CASE WHEN tm IS NULL THEN '' ELSE ' ORDER BY `' || tm || '` DESC' END || ' LIMIT 5' AS sql FROM n)
SELECT 'auto_' || substr(sha256('src|' || question || '|' || sql), 1, 24) AS sample_id, t AS "table", question, sql FROM q""")
register("D19_semantics", lambda s, d: filled_semantics(_catalogue(s, d).select("table", "column"), _profiled(s, d), display="source", suggested=_profiled(s, d).select("table", F.when(F.col("time_column") == "c2", "c3").otherwise("gone").alias("time_column"))), """
WITH c AS (SELECT p_partkey // 8 AS k, p_partkey % 8 AS j FROM part), p AS (SELECT p_partkey // 8 AS k FROM part WHERE p_partkey % 8 = 0 AND p_partkey % 7 > 0), h AS (SELECT DISTINCT k FROM c WHERE j = 3)
SELECT 't' || c.k AS "table", CASE j WHEN 0 THEN 'phone' WHEN 1 THEN 'geom' ELSE 'c' || j END AS "column", CASE WHEN p.k IS NOT NULL AND c.k % 2 = 0 THEN '水质' ELSE 'source' END AS domain, CASE WHEN p.k IS NOT NULL AND c.k % 2 = 0 THEN '水质' ELSE 't' || c.k || ' 业务数据' END AS summary,
  CASE WHEN p.k IS NOT NULL THEN '日' ELSE '待语义确认' END AS grain, CASE WHEN p.k IS NULL THEN '' WHEN c.k % 3 = 0 THEN CASE WHEN h.k IS NOT NULL THEN 'c3' ELSE 'c2' END WHEN c.k % 3 = 1 THEN 'c7' ELSE '' END AS time_column, CASE WHEN p.k IS NOT NULL AND c.k % 4 = 0 THEN '事实表' ELSE '业务表' END AS role
FROM c LEFT JOIN p ON c.k = p.k LEFT JOIN h ON c.k = h.k""")
_DDL = (
    "CREATE TABLE public.\"t\" (id BIGINT PRIMARY KEY, -- the key, of all\n name VARCHAR(20) DEFAULT 'a, b', price DECIMAL(10, 2)); CREATE UNIQUE INDEX ix_t ON t (name, price DESC)",
    "create table if not exists `u` (`a` int not null, `b` text, primary key (`a`, `b`), unique key uk (`b`), key k2 (`a`)) engine=InnoDB", "DROP TABLE t", "CREATE TABLE v (x int, CONSTRAINT pv PRIMARY KEY (x), CONSTRAINT uv UNIQUE (x))",
)
register("D16_ddl_keys", lambda s, d: table(s, d, "orders").select("o_orderkey", ddl_keys(F.get(F.array(*map(F.lit, _DDL)), (F.col("o_orderkey") % 4).cast("int"))).alias("k")).select("o_orderkey", F.col("k.table").alias("table"), F.array_join(F.transform("k.columns", lambda c: F.concat(c["name"], F.lit(" "), c["type"])), "|").alias("columns"),
                                                                                                                                                                F.array_join("k.primary_key", ",").alias("primary_key"), F.array_join(F.transform("k.indexes", lambda i: F.concat(i["name"], F.lit(":"), i["unique"].cast("string"), F.lit(":"), F.array_join(i["columns"], ","))), "|").alias("indexes")), """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 't' WHEN 1 THEN 'u' WHEN 3 THEN 'v' END AS "table", CASE o_orderkey % 4 WHEN 0 THEN 'id bigint|name varchar(20)|price decimal(10, 2)' WHEN 1 THEN 'a int|b text' WHEN 3 THEN 'x int' END AS columns,
  CASE o_orderkey % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'a,b' WHEN 3 THEN 'x' END AS primary_key, CASE o_orderkey % 4 WHEN 0 THEN 'ix_t:true:name,price' WHEN 1 THEN 'uk:true:b|k2:false:a' WHEN 3 THEN 'uv:true:x' END AS indexes FROM orders""")
