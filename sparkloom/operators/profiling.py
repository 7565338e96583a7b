"""Profiles of tables and their columns, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import distinct_counts
from ..registry import register
from ..sources import footers
from ..sources.tables import KEYS, sample, table

#: Parts of names whose values are not shown.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "private_key", "id_card", "idcard", "身份证", "手机号", "phone", "mobile", "email", "邮箱", "住址", "address")
#: Parts of names that mark a time.
TIME_WORDS = ("time", "date", "日期", "时间", "created_at", "updated_at")
#: Parts of a table's name or comment that tell its role; the first that matches counts.
ROLES = (("日志表", ("log", "日志", "history", "历史", "audit")), ("字典表", ("dict", "字典", "lookup", "code_table")), ("配置表", ("config", "配置", "setting")), ("事实表", ("detail", "record", "monitor", "监测", "流水")))
OTHER_ROLE = "业务表"
_SKIPPED = (T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(text), F.lit(w))
    return found


def sensitive(name: Column) -> Column:
    return holds_any(name, SENSITIVE)


def role(name: Column, comment: Column) -> Column:
    """What a table is for, by words in its name and comment."""
    text, found = F.concat_ws(" ", name, comment), None
    for label, words in ROLES:
        found = (F if found is None else found).when(holds_any(text, words), label)
    return found.otherwise(OTHER_ROLE)


def profiled(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if not isinstance(f.dataType, _SKIPPED)]


def ordered(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def columns(df: DataFrame, limit: int = 20) -> DataFrame:
    """Per column: null rate, distinct count, and, of numbers and times, min and max as text; up to `limit` typical values
    of columns with no more of them and no sensitive name.

    One aggregation over all columns, whose row is then turned into rows; distinct values are counted beside it.
    """
    fields = profiled(df)
    made = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        made += [F.count_if(c.isNull()).alias(f"{f.name}|nulls")]
        made += [F.min(c).cast("string").alias(f"{f.name}|min"), F.max(c).cast("string").alias(f"{f.name}|max")] if ordered(f.dataType) else []
    wide = df.agg(F.count("*").alias("|rows"), *made)
    get = lambda f, what: F.col(f"`{f.name}|{what}`")
    rate = lambda f: F.round(F.try_divide(get(f, "nulls"), F.col("`|rows`")), 4)
    text = lambda f, what: get(f, what) if ordered(f.dataType) else F.lit(None).cast("string")
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), rate(f).alias("null_rate"), text(f, "min").alias("min"), text(f, "max").alias("max")) for f in fields])
    out = wide.select(F.inline(rows)).join(distinct_counts(df, [f.name for f in fields]), "column", "left")
    return out.select("column", "type", "null_rate", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct_count"), "min", "max", sensitive(F.col("column")).alias("sensitive"))


def typical_values(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """The distinct values of a column as text, sorted, if there are at most `limit` of them and its name isn't sensitive."""
    got = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct().orderBy("v").limit(limit + 1)
    listed = got.agg(F.array_sort(F.collect_list("v")).alias("values"))
    return listed.select(F.lit(column).alias("column"), F.when((F.size("values") <= limit) & ~sensitive(F.lit(column)), F.array_join("values", "|")).alias("typical"))


def time_column(df: DataFrame, most: int = 3) -> DataFrame:
    """The first column with times among the first few candidates by type or name, its latest value and the days covered."""
    named = lambda f: any(w in f.name.lower() for w in TIME_WORDS)
    fields = [f for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) or named(f)][:most]
    if not fields:
        return df.sparkSession.range(1).select(F.lit(None).cast("string").alias("time_column"), F.lit(None).cast("string").alias("latest"), F.lit(None).cast("double").alias("days"))
    stamp = lambda f: F.col(f.name).try_cast("timestamp")
    wide = df.agg(*[F.max(stamp(f)).alias(f"max{i}") for i, f in enumerate(fields)], *[F.min(stamp(f)).alias(f"min{i}") for i, f in enumerate(fields)])
    pick = None
    for i, f in enumerate(fields):
        days = F.round((F.unix_micros(f"max{i}") - F.unix_micros(f"min{i}")) / 86_400e6, 3)
        pick = (F if pick is None else pick).when(F.col(f"max{i}").isNotNull(), F.struct(F.lit(f.name).alias("time_column"), F.col(f"max{i}").cast("string").alias("latest"), days.alias("days")))
    return wide.select(pick.alias("p")).select("p.*")


def duplicate_key_ratio(df: DataFrame, keys: list[str], sample: int | None = None) -> DataFrame:
    """Rows in groups that share a key, over all rows; null without a key. With `sample`, over that many rows, as a bounded
    look has it."""
    if not keys:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("duplicate_key_ratio"))
    rows = df.orderBy(*keys).limit(sample) if sample else df
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    got = counts.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("d"), F.sum("n").alias("all"))
    return got.select(F.round(F.try_divide(F.col("d").cast("double"), F.lit(sample).cast("double") if sample else F.col("all").cast("double")), 4).alias("duplicate_key_ratio"))


def null_rate(df: DataFrame) -> DataFrame:
    """Nulls among all cells."""
    fields = profiled(df)
    nulls = sum((F.col(f"`{f.name}`").isNull().cast("long") for f in fields), F.lit(0))
    return df.agg(F.sum(nulls).alias("n"), F.count("*").alias("r")).select(F.round(F.try_divide("n", F.col("r") * max(1, len(fields))), 4).alias("null_rate"))


def structure_fingerprint(metadata: DataFrame) -> DataFrame:
    """Per table: SHA-256 of its sorted column|type pairs."""
    pairs = F.array_sort(F.collect_list(F.concat_ws("|", "column", "type")))
    return metadata.groupBy("table").agg(F.sha2(F.array_join(pairs, "|"), 256).alias("fingerprint"))


def data_fingerprint(df: DataFrame, keys: list[str] | None = None, rows: int = 200, width: int = 40) -> DataFrame:
    """SHA-256 of the sorted cells, as text, of the first `rows` rows by key (by all columns without one), of at most `width`
    columns; null and sensitive cells are left out."""
    held = sample(df, keys or [], rows, width)
    names = [f.name for f in profiled(held) if not any(w in f.name.lower() for w in SENSITIVE)]
    cells = held.select(F.explode(F.array(*[F.col(f"`{n}`").cast("string") for n in names])).alias("v")).filter("v IS NOT NULL")
    return cells.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("v")), "|"), 256).alias("fingerprint"))


def queryable(metadata: DataFrame) -> DataFrame:
    """Columns of plain types that aren't bare keys."""
    plain = F.col("type").rlike(r"int|decimal|double|float|real|numeric|date|time|string|char") & ~F.col("type").rlike(r"^(array|map|struct|binary)")
    return metadata.filter(plain & ~F.lower("column").isin("id", "row_id", "pk", "key"))


def _holed(s: SparkSession, d: str) -> DataFrame:
    """Orders with holes, as the tables have none."""
    o = table(s, d, "orders")
    return o.withColumns({"o_orderpriority": F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")), "o_totalprice": F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice"))})


_HOLED = "WITH h AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders) "
_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
register("P1_null_rate", lambda s, d: columns(_holed(s, d)).select("column", "null_rate"), _HOLED + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(count(*) FILTER ({c} IS NULL) / count(*), 4) AS null_rate FROM h" for c in _COLS))
register("P2_distinct_count", lambda s, d: columns(_holed(s, d)).select("column", "distinct_count"), _HOLED + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM h" for c in _COLS))
register("P3_min_max", lambda s, d: columns(_holed(s, d)).filter("column IN ('o_orderkey', 'o_custkey')").select("column", "min", "max"), _HOLED + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM h" for c in _COLS[:2]))
register("P4_typical_values", lambda s, d: typical_values(_holed(s, d), "o_orderpriority").unionByName(typical_values(_holed(s, d), "o_custkey")),
         _HOLED + "SELECT 'o_orderpriority' AS \"column\", string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS typical FROM h UNION ALL SELECT 'o_custkey', NULL")
_ENDS = ("c_phone", "mail_address", "user_token", "value", "monitor_log", "code_table", "app_config", "pay_record", "river", "audit_detail", "Email", "")
_named = lambda s, d: table(s, d, "part").select(
    "p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("p_partkey") % len(_ENDS) + 1).cast("int"))).alias("name"), F.when(F.col("p_size") % 10 == 0, F.concat("p_type", F.lit(" 监测"))).alias("comment"))
_NAMED = f"WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || {list(_ENDS)}[p_partkey % {len(_ENDS)} + 1] AS name, CASE WHEN p_size % 10 = 0 THEN p_type || ' 监测' END AS comment FROM part) "
register("P5_sensitive", lambda s, d: _named(s, d).select("p_partkey", "name", sensitive(F.col("name")).alias("sensitive")), _NAMED + f"SELECT p_partkey, name, regexp_matches(lower(name), '{'|'.join(SENSITIVE)}') AS sensitive FROM n")
register("P6_role", lambda s, d: _named(s, d).select("p_partkey", role(F.col("name"), F.col("comment")).alias("role")), _NAMED + "SELECT p_partkey, CASE " + " ".join(
    f"WHEN regexp_matches(lower(concat_ws(' ', name, comment)), '{'|'.join(words)}') THEN '{label}'" for label, words in ROLES) + f" ELSE '{OTHER_ROLE}' END AS role FROM n")
register("P7_time_column", lambda s, d: time_column(table(s, d, "orders")).select("time_column"), "SELECT 'o_orderdate' AS time_column")
register("P8_time_coverage", lambda s, d: time_column(table(s, d, "events")).select("days"), "SELECT round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0::DOUBLE, 3) AS days FROM events")
register("P9_duplicate_keys", lambda s, d: duplicate_key_ratio(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT round(CAST(sum(n) FILTER (n > 1) AS DOUBLE) / sum(n), 4) AS duplicate_key_ratio FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
register("P10_null_rate_of_cells", lambda s, d: null_rate(_holed(s, d)), _HOLED + "SELECT round((count(*) FILTER (o_totalprice IS NULL) + count(*) FILTER (o_orderpriority IS NULL)) / (count(*) * 6), 4) AS null_rate FROM h")


def _own_metadata(s: SparkSession, d: str) -> DataFrame:
    rows = [(n, f.name, f.dataType.simpleString(), f.name in KEYS.get(n, ()), i) for n in ("region", "nation", "customer", "supplier", "part") for i, f in enumerate(table(s, d, n).schema)]
    return s.createDataFrame(rows, "table string, column string, type string, primary_key boolean, place int")


_TYPES = "WITH m AS (SELECT table_name AS tbl, column_name AS col, CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part')) "
register("P11_structure_fingerprint", lambda s, d: structure_fingerprint(_own_metadata(s, d)), _TYPES + "SELECT tbl AS \"table\", sha256(string_agg(concat(col, '|', type), '|' ORDER BY concat(col, '|', type))) AS fingerprint FROM m GROUP BY tbl")
register("P12_data_fingerprint", lambda s, d: data_fingerprint(table(s, d, "nation"), ["n_nationkey"]), "SELECT sha256(string_agg(v, '|' ORDER BY v)) AS fingerprint FROM (SELECT CAST(n_nationkey AS VARCHAR) AS v FROM nation UNION ALL SELECT n_name FROM nation UNION ALL SELECT CAST(n_regionkey AS VARCHAR) FROM nation)")
register("P12_sampled_fingerprint", lambda s, d: data_fingerprint(table(s, d, "customer").drop("c_acctbal"), ["c_custkey"], 50).withColumn("table", F.lit("customer")), """
WITH c AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 50), v AS (SELECT unnest([CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS v FROM c)
SELECT sha256(string_agg(v, '|' ORDER BY v)) AS fingerprint, 'customer' AS "table" FROM v""")
register("P13_grain", lambda s, d: _own_metadata(s, d).filter("primary_key").groupBy("table").agg(F.array_join(F.array_sort(F.collect_list("column")), " + ").alias("grain")),
         "SELECT * FROM (VALUES ('region', 'r_regionkey'), ('nation', 'n_nationkey'), ('customer', 'c_custkey'), ('supplier', 's_suppkey'), ('part', 'p_partkey')) AS t(\"table\", grain)")
register("P14_queryable_columns", lambda s, d: queryable(_own_metadata(s, d)).groupBy("table").agg(F.count("*").alias("n")), _TYPES + "SELECT tbl AS \"table\", count(*) AS n FROM m GROUP BY tbl")
register("P16_comment_ratio", lambda s, d: _own_metadata(s, d).withColumn("comment", F.when(F.col("place") % 2 == 0, "said")).groupBy("table").agg(F.round(F.avg(F.col("comment").isNotNull().cast("int")), 4).alias("ratio")),
         _TYPES + "SELECT tbl AS \"table\", round(ceil(count(*) / 2.0) / count(*), 4)::DOUBLE AS ratio FROM m GROUP BY tbl")

_FOOTED = {"orders": ("o_orderkey", "o_custkey", "o_totalprice"), "customer": ("c_custkey", "c_nationkey", "c_acctbal"), "lineitem": ("l_orderkey", "l_linenumber", "l_discount"), "part": ("p_partkey", "p_size"), "labels": ("doc_id", "toxic")}
register("S7_footer_statistics", lambda s, d: footers.statistics(s, {t: f"{d}/{t}.parquet" for t in _FOOTED}, keys=lambda t: KEYS[t]).filter(" OR ".join(f"(`table` = '{t}' AND `column` IN {cs})" for t, cs in _FOOTED.items())).select(
    "table", "column", "rows", "nulls", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "primary_key"), " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, {c in KEYS.get(t, ())} AS primary_key FROM {t}" for t, cs in _FOOTED.items() for c in cs))
