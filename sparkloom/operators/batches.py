"""Training batches: what is wrong with their samples, their digest, bounded evidence and checks of suites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import normal_text, statements
from ..registry import register
from ..sources.tables import table
from .corpus import redact

#: Fields of a sample and of a batch that its digest covers, apart from its counts.
SAMPLE_FIELDS = ("sample_id", "question", "tool_name", "sql", "training_level", "train_decision", "review_reason", "source", "expected_behavior", "expected_tables")
BATCH_FIELDS = ("schema_version", "training_batch_id", "training_level", "status", "source", "expected_new_memory_count")


def table_names(names: Column) -> Column:
    """Distinct last parts of tables' names in lower case, without quotes, in order; blank ones go."""
    bare = lambda x: F.regexp_replace(x, r'^["`\[\]]+|["`\[\]]+$', "")
    return F.array_sort(F.array_distinct(F.transform(F.filter(names, lambda x: F.trim(x) != ""), lambda x: bare(F.substring_index(F.lower(bare(F.trim(x))), ".", -1)))))


def issues(samples: DataFrame, batches: DataFrame, checked: DataFrame) -> DataFrame:
    """training_batch_id, sample_id ("-" for the batch), code: all that keeps a batch from being written.

    samples: training_batch_id and SAMPLE_FIELDS. batches: BATCH_FIELDS. checked: training_batch_id, sample_id, passed and
    used_tables, what a guard found for each sample; a sample without a row there counts as rejected.
    """
    c = F.col
    blank = lambda x: F.trim(F.coalesce(c(x), F.lit(""))) == ""
    head = batches.select("training_batch_id", c("training_level").alias("_level"))
    both = samples.join(head, "training_batch_id").join(checked.select("training_batch_id", "sample_id", "passed", "used_tables"), ["training_batch_id", "sample_id"], "left")
    expected = table_names(c("expected_tables"))
    found = F.array(
        F.when(blank("question"), "EMPTY_QUESTION"), F.when(blank("sql"), "EMPTY_SQL"), F.when(~c("training_level").eqNullSafe(c("_level")), "SAMPLE_LEVEL_MISMATCH"),
        F.when(~c("train_decision").eqNullSafe(F.lit("approved")), "SAMPLE_NOT_APPROVED"), F.when(~c("tool_name").eqNullSafe(F.lit("run_sql")), "UNSUPPORTED_TOOL"),
        F.when(blank("review_reason") | blank("source") | blank("expected_behavior") | (F.size(expected) == 0) | (F.size(expected) != F.size("expected_tables")), "BATCH_SCHEMA_INVALID"),
        F.when(statements(F.coalesce("sql", F.lit(""))) > 1, "SQL_MULTIPLE_STATEMENTS"), F.when(~F.coalesce("passed", F.lit(False)), "SQL_GUARD_REJECTED"),
        F.when(c("used_tables").isNotNull() & (table_names(c("used_tables")) != expected), "EXPECTED_TABLES_MISMATCH"))
    own = both.select("training_batch_id", "sample_id", F.explode(F.array_compact(found)).alias("code"))
    twice = samples.groupBy("training_batch_id", "sample_id").count().filter("count > 1").select("training_batch_id", "sample_id", F.lit("DUPLICATE_SAMPLE_ID").alias("code"))
    sizes = batches.join(samples.groupBy("training_batch_id").agg(F.count("*").alias("_n")), "training_batch_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    whole = F.array(F.when(~c("schema_version").eqNullSafe(F.lit("1.0")) | blank("source") | (c("_n") == 0), "BATCH_SCHEMA_INVALID"), F.when(~c("status").eqNullSafe(F.lit("frozen")), "BATCH_NOT_FROZEN"),
                    F.when(c("expected_new_memory_count") != c("_n"), "BATCH_COUNT_MISMATCH"))
    of_batch = sizes.select("training_batch_id", F.lit("-").alias("sample_id"), F.explode(F.array_compact(whole)).alias("code"))
    return reduce(DataFrame.unionByName, (own, twice, of_batch))


def digest(samples: DataFrame, batches: DataFrame) -> DataFrame:
    """training_batch_id, sha256 of the batch as JSON with sorted keys: texts trimmed, SQL and tables in normal form, samples
    by their place. Needs `place` in samples. A batch's samples are one value: they are written by hand, a few hundred."""
    t = lambda x: F.trim(F.col(x)).alias(x)
    sample = F.struct(F.struct(normal_text(F.col("sql")).alias("sql")).alias("args"), t("expected_behavior"), table_names(F.col("expected_tables")).alias("expected_tables"), t("question"), t("review_reason"), "sample_id", t("source"), "tool_name", "train_decision", "training_level")
    own = samples.groupBy("training_batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", sample.alias("s")))), lambda x: x["s"]).alias("samples"))
    both = batches.join(own, "training_batch_id")
    body = F.struct("expected_new_memory_count", F.size("samples").alias("sample_count"), F.transform("samples", lambda s: s["sample_id"]).alias("sample_ids"), "samples", "schema_version", t("source"), "status", "training_batch_id", "training_level")
    return both.select("training_batch_id", F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256).alias("sha256"))


def capture_gate(runs: DataFrame, max_answer: int = 4000) -> DataFrame:
    """runs with reason: capture, or the first thing that keeps a run from being learned from.

    Needs: question, answer, sql, success, calls (of SQL), errors, retries, warnings, severity, row_count, columns (array), timed_out, cancelled,
    source, data_question (whether it asked for data), from_memory (whether the SQL came from a stored example)."""
    c = F.col
    blank = lambda x: F.trim(F.coalesce(c(x), F.lit(""))) == ""
    reason = (F.when(blank("question"), "no_question").when(blank("source"), "no_source").when(c("cancelled"), "cancelled").when(c("timed_out"), "timed_out").when(~c("data_question"), "no_data_question")
              .when(~F.coalesce("success", F.lit(False)), "failed").when(c("calls") != 1, "not_one_query").when(c("errors") > 0, "tool_error").when(c("retries") > 0, "retried").when(blank("sql"), "no_sql")
              .when(statements(c("sql")) != 1, "several_statements").when((c("warnings") > 0) | (c("severity") != "ok"), "guard_warning").when(c("from_memory"), "known_example")
              .when(c("row_count").isNull() | (c("row_count") < 1), "no_rows").when(F.size("columns") == 0, "no_columns").when(blank("answer"), "no_answer").when(F.length("answer") > max_answer, "long_answer"))
    return runs.withColumn("reason", F.coalesce(reason, F.lit("capture")))


def evidence(df: DataFrame, keys: list[str], rows: int = 20, cell: int = 200, size: int = 8000) -> DataFrame:
    """The first rows of a result as evidence: texts redacted and cut to `cell` characters, `rows` rows at most, and so often
    half of them as make the JSON of all fit into `size` characters; one row is kept. A sample by its purpose: a bounded look."""
    out = [F.substring(redact(F.col(f.name)), 1, cell).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema]
    first = df.orderBy(*keys).limit(rows).select(*out).coalesce(1).withColumn("_k", F.monotonically_increasing_id())
    lengths = first.agg(F.array_sort(F.collect_list(F.struct("_k", F.length(F.to_json(F.struct(*df.columns))).alias("n")))).alias("l"))  # at most `rows`
    steps = F.transform(F.sequence(F.lit(0), F.lit(max(rows.bit_length(), 1))), lambda i: F.floor(F.size("l") / F.pow(F.lit(2), i)).cast("int"))
    fits = F.filter(steps, lambda n: (n >= 1) & (F.aggregate(F.slice("l", F.lit(1), n), F.lit(0), lambda a, x: a + x["n"] + 1) + 1 <= size))
    return first.join(F.broadcast(lengths.select(F.greatest(F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(1)), F.lit(1)).alias("_n")))).filter("_k < _n").drop("_k", "_n")


def suite_failures(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """case_id, failure: what a run of a suite lacks. cases: case_id, expected_tables, forbidden_tables, expected_columns,
    chart_types, sql_contains, sql_excludes (arrays), allow_empty, exact_columns, max_rows (or null). runs: case_id, sql, tables, columns, charts, rows,
    passed. A case without a run fails as not_run; a null array asks for nothing."""
    c = F.col
    low = lambda x: F.transform(F.coalesce(c(x), F.array().cast("array<string>")), lambda v: F.lower(v))
    lacks = lambda a, b: F.size(F.array_except(low(a), low(b))) > 0
    text = F.lower(F.coalesce("sql", F.lit("")))
    same = (F.array_sort(F.array_distinct(low("expected_columns"))) == F.array_sort(F.array_distinct(low("columns")))) | (F.size(low("expected_columns")) == 0)
    missing = c("_ran").isNull()
    checks = F.array(
        F.when(missing, "not_run"), F.when(~missing & ~F.coalesce("passed", F.lit(False)), "guard"), F.when(~missing & lacks("expected_tables", "tables"), "expected_table"),
        F.when(F.arrays_overlap(low("forbidden_tables"), low("tables")), "forbidden_table"), F.when(~missing & F.when(c("exact_columns"), ~same).otherwise(lacks("expected_columns", "columns")), "columns"),
        F.when(~missing & lacks("chart_types", "charts"), "chart"), F.when(~missing & F.exists(low("sql_contains"), lambda v: ~F.contains(text, v)), "sql_lacks"), F.when(F.exists(low("sql_excludes"), lambda v: F.contains(text, v)), "sql_holds"),
        F.when(~missing & (F.coalesce("rows", F.lit(0)) == 0) & ~c("allow_empty"), "empty"), F.when(c("rows") > c("max_rows"), "rows"))
    return cases.join(runs.withColumn("_ran", F.lit(True)), "case_id", "left").select("case_id", F.explode(F.array_compact(checks)).alias("failure"))


_TEXTS = (
    "SELECT  a FROM t -- why\n WHERE b = 'x  -- y' ; ", "SELECT 1; SELECT 2", "select ';' as a /* ; */;;", "-- only\n/* this */", "SELECT \"a  b\"\n,'it''s;' FROM t;", "a/b - c", "SELECT 'open  ; text", "/* open  ; text",
)
_sql_texts = lambda s, d: table(s, d, "orders").select("o_orderkey", F.concat(F.get(F.array(*map(F.lit, _TEXTS)), (F.col("o_orderkey") % 8).cast("int")), F.lit("  "), F.when(F.col("o_custkey") % 2 == 0, "").otherwise("\t")).alias("sql"))
register("B1_normal_text", lambda s, d: _sql_texts(s, d).select("o_orderkey", normal_text(F.col("sql")).alias("text")), """
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'SELECT a FROM t WHERE b = ''x  -- y''' WHEN 1 THEN 'SELECT 1; SELECT 2' WHEN 2 THEN 'select '';'' as a ;' WHEN 3 THEN '' WHEN 4 THEN 'SELECT "a  b" ,''it''''s;'' FROM t'
  WHEN 5 THEN 'a/b - c' WHEN 6 THEN trim('SELECT ''open  ; text' || '  ' || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE chr(9) END, ' ') ELSE '' END AS text FROM orders""")
register("B2_statements", lambda s, d: _sql_texts(s, d).select("o_orderkey", statements(F.col("sql")).cast("long").alias("n")), "SELECT o_orderkey, CAST(CASE o_orderkey % 8 WHEN 1 THEN 2 WHEN 3 THEN 0 WHEN 7 THEN 0 ELSE 1 END AS BIGINT) AS n FROM orders")


def _samples(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    when = lambda c, a, b: F.when(c, a).otherwise(b)
    return table(s, d, "part").select(
        F.floor(k / 20).cast("long").alias("training_batch_id"), F.concat(F.lit("s"), (k % 19).cast("string")).alias("sample_id"), k.alias("place"), when(k % 23 == 0, "  ", F.col("p_name")).alias("question"), when(k % 29 == 0, "bash", "run_sql").alias("tool_name"),
        F.concat(F.lit("SELECT  p_size FROM part WHERE p_name = 'a  b'"), when(k % 31 == 0, "; SELECT 2", ";")).alias("sql"), when(k % 37 == 0, "L2", "L1").alias("training_level"), when(k % 41 == 0, "draft", "approved").alias("train_decision"),
        F.lit(" fine").alias("review_reason"), F.lit("test").alias("source"), F.lit("rows").alias("expected_behavior"), when(k % 43 == 0, F.array(F.lit("part"), F.lit("PART")), F.array(F.lit('public."Part"'))).alias("expected_tables"), k)


def _batches(s: SparkSession, d: str) -> DataFrame:
    whole = table(s, d, "part").select(F.floor(F.col("p_partkey") / 20).cast("long").alias("training_batch_id")).groupBy("training_batch_id").agg(F.count("*").alias("n"))
    k = F.col("training_batch_id")
    return whole.select("training_batch_id", F.when(k % 5 == 0, "0.9").otherwise("1.0").alias("schema_version"), F.lit("L1").alias("training_level"), F.when(k % 3 == 0, "open").otherwise("frozen").alias("status"), F.lit(" test ").alias("source"), F.when(k % 4 == 0, F.lit(20).cast("long")).otherwise(F.col("n") + 1).alias("expected_new_memory_count"))


_checked = lambda s, d: _samples(s, d).groupBy("training_batch_id", "sample_id").agg(F.min(F.col("p_partkey") % 47 > 0).alias("passed"), F.max(F.when(F.col("p_partkey") % 53 == 0, F.array(F.lit("supplier"))).otherwise(F.array(F.lit("part")))).alias("used_tables"))
register("B3_batch_issues", lambda s, d: issues(_samples(s, d), _batches(s, d), _checked(s, d)).groupBy("training_batch_id", "code").agg(F.count("*").alias("n")), """
WITH s AS (SELECT p_partkey AS k, p_partkey // 20 AS b, p_partkey % 19 AS id FROM part), g AS (SELECT b, id, bool_and(k % 47 > 0) AS passed, bool_or(k % 53 = 0) AS other, count(*) AS n FROM s GROUP BY 1, 2),
h AS (SELECT b, count(*) AS n FROM s GROUP BY b), i AS (
  SELECT b, 'EMPTY_QUESTION' AS code FROM s WHERE k % 23 = 0 UNION ALL SELECT b, 'SAMPLE_LEVEL_MISMATCH' FROM s WHERE k % 37 = 0 UNION ALL SELECT b, 'SAMPLE_NOT_APPROVED' FROM s WHERE k % 41 = 0
  UNION ALL SELECT b, 'UNSUPPORTED_TOOL' FROM s WHERE k % 29 = 0 UNION ALL SELECT b, 'BATCH_SCHEMA_INVALID' FROM s WHERE k % 43 = 0 UNION ALL SELECT b, 'SQL_MULTIPLE_STATEMENTS' FROM s WHERE k % 31 = 0
  UNION ALL SELECT b, 'SQL_GUARD_REJECTED' FROM s JOIN g USING (b, id) WHERE NOT passed UNION ALL SELECT b, 'EXPECTED_TABLES_MISMATCH' FROM s JOIN g USING (b, id) WHERE other UNION ALL SELECT b, 'DUPLICATE_SAMPLE_ID' FROM g WHERE n > 1
  UNION ALL SELECT b, 'BATCH_SCHEMA_INVALID' FROM h WHERE b % 5 = 0 UNION ALL SELECT b, 'BATCH_NOT_FROZEN' FROM h WHERE b % 3 = 0 UNION ALL SELECT b, 'BATCH_COUNT_MISMATCH' FROM h WHERE b % 4 <> 0 OR n <> 20)
SELECT b AS training_batch_id, code, count(*) AS n FROM i GROUP BY 1, 2""")
register("B4_batch_digest", lambda s, d: digest(_samples(s, d), _batches(s, d)), """
WITH h AS (SELECT p_partkey // 20 AS b, count(*) AS n, list('s' || p_partkey % 19 ORDER BY p_partkey) AS ids,
  string_agg('{"args":{"sql":"SELECT p_size FROM part WHERE p_name = ''a  b''' || CASE WHEN p_partkey % 31 = 0 THEN '; SELECT 2' ELSE '' END || '"},"expected_behavior":"rows","expected_tables":["part"],"question":"' || CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_name END
    || '","review_reason":"fine","sample_id":"s' || p_partkey % 19 || '","source":"test","tool_name":"' || CASE WHEN p_partkey % 29 = 0 THEN 'bash' ELSE 'run_sql' END || '","train_decision":"' || CASE WHEN p_partkey % 41 = 0 THEN 'draft' ELSE 'approved' END
    || '","training_level":"' || CASE WHEN p_partkey % 37 = 0 THEN 'L2' ELSE 'L1' END || '"}', ',' ORDER BY p_partkey) AS samples FROM part GROUP BY 1)
SELECT b AS training_batch_id, sha256('{"expected_new_memory_count":' || CASE WHEN b % 4 = 0 THEN 20 ELSE n + 1 END || ',"sample_count":' || n || ',"sample_ids":["' || array_to_string(ids, '","') || '"],"samples":[' || samples || '],"schema_version":"'
  || CASE WHEN b % 5 = 0 THEN '0.9' ELSE '1.0' END || '","source":"test","status":"' || CASE WHEN b % 3 = 0 THEN 'open' ELSE 'frozen' END || '","training_batch_id":' || b || ',"training_level":"L1"}') AS sha256 FROM h""")
_k = lambda n: F.col("o_orderkey") % n
register("L4_capture_gate", lambda s, d: capture_gate(table(s, d, "orders").select(
    "o_orderkey", F.when(_k(19) == 0, " ").otherwise("q").alias("question"), F.lit("src").alias("source"), (_k(17) == 0).alias("cancelled"), F.lit(False).alias("timed_out"), (_k(13) != 0).alias("data_question"), (_k(11) != 0).alias("success"), F.lit(1).alias("calls"), F.lit(0).alias("errors"),
    F.when(_k(9) == 0, 1).otherwise(0).alias("retries"), F.when(_k(8) == 0, "select 1; select 2").otherwise("select ';'").alias("sql"), F.lit(0).alias("warnings"), F.when(_k(7) == 0, "warning").otherwise("ok").alias("severity"), (_k(6) == 0).alias("from_memory"),
    F.when(_k(5) > 0, _k(5)).alias("row_count"), F.array(F.lit("a")).alias("columns"), F.repeat(F.lit("x"), F.when(_k(4) == 0, 4001).otherwise(7)).alias("answer"))).select("o_orderkey", "reason"), """
SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'no_question' WHEN o_orderkey % 17 = 0 THEN 'cancelled' WHEN o_orderkey % 13 = 0 THEN 'no_data_question' WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderkey % 9 = 0 THEN 'retried' WHEN o_orderkey % 8 = 0 THEN 'several_statements'
  WHEN o_orderkey % 7 = 0 THEN 'guard_warning' WHEN o_orderkey % 6 = 0 THEN 'known_example' WHEN o_orderkey % 5 = 0 THEN 'no_rows' WHEN o_orderkey % 4 = 0 THEN 'long_answer' ELSE 'capture' END AS reason FROM orders""")
register("L5_evidence", lambda s, d: evidence(table(s, d, "customer").select("c_custkey", F.concat("c_name", F.repeat(F.lit("-"), 300)).alias("name"), F.concat(F.lit("key sk-abcdefgh"), F.col("c_custkey").cast("string")).alias("note")), ["c_custkey"], rows=20, cell=100, size=1700),
         "SELECT c_custkey, substr(c_name || repeat('-', 300), 1, 100) AS name, 'key [REDACTED]' AS note FROM customer ORDER BY c_custkey LIMIT 10")
_cases = lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("case_id"), F.array(F.lit("part")).alias("expected_tables"), F.array(F.lit("orders")).alias("forbidden_tables"), F.array(F.lit("a"), F.lit("b")).alias("expected_columns"),
                                                  F.lit(None).cast("array<string>").alias("chart_types"), F.array(F.lit("LIMIT")).alias("sql_contains"), F.array(F.lit("drop")).alias("sql_excludes"), (F.col("p_partkey") % 2 == 0).alias("allow_empty"), (F.col("p_partkey") % 3 == 0).alias("exact_columns"), F.lit(40).alias("max_rows"))
_runs = lambda s, d: table(s, d, "part").filter("p_partkey % 10 > 0").select(F.col("p_partkey").alias("case_id"), F.when(F.col("p_partkey") % 7 == 0, "select 1").otherwise("select a limit 5").alias("sql"), F.when(F.col("p_partkey") % 11 == 0, F.array(F.lit("Orders"))).otherwise(F.array(F.lit("PART"))).alias("tables"),
                                                                             F.array(F.lit("A"), F.lit("B"), F.lit("c")).alias("columns"), F.array().cast("array<string>").alias("charts"), (F.col("p_size") - 1).alias("rows"), (F.col("p_partkey") % 13 > 0).alias("passed"))
register("L12_suite_failures", lambda s, d: suite_failures(_cases(s, d), _runs(s, d)), """
WITH r AS (SELECT p_partkey AS k, p_size - 1 AS n FROM part WHERE p_partkey % 10 > 0)
SELECT p_partkey AS case_id, 'not_run' AS failure FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT k, 'guard' FROM r WHERE k % 13 = 0 UNION ALL SELECT k, 'expected_table' FROM r WHERE k % 11 = 0 UNION ALL SELECT k, 'forbidden_table' FROM r WHERE k % 11 = 0
UNION ALL SELECT k, 'columns' FROM r WHERE k % 3 = 0 UNION ALL SELECT k, 'sql_lacks' FROM r WHERE k % 7 = 0 UNION ALL SELECT k, 'empty' FROM r WHERE n = 0 AND k % 2 > 0 UNION ALL SELECT k, 'rows' FROM r WHERE n > 40""")
