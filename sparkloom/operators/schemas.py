"""Schema diffs, classification, scope and relations, over metadata rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import register
from ..sources.tables import table

KEY = ("table", "column")


def check_metadata(rows: DataFrame) -> DataFrame:
    """What is wrong with metadata rows: (table, column, problem)."""
    blank = rows.filter("table IS NULL OR table = '' OR column IS NULL OR column = ''").select("table", "column", F.lit("blank name").alias("problem"))
    twice = rows.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").select("table", "column", F.lit("repeated column").alias("problem"))
    comments = rows.groupBy("table").agg(F.count_distinct("table_comment").alias("n")).filter("n > 1").select("table", F.lit(None).cast("string").alias("column"), F.lit("several table comments").alias("problem"))
    return blank.unionByName(twice).unionByName(comments)


def diff(old: DataFrame, new: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(table, column, change, fields): added, removed or changed columns, and which of `fields` differ. Nulls are equal."""
    a, b = old.select(*KEY, F.struct(*fields).alias("old")), new.select(*KEY, F.struct(*fields).alias("new"))
    both = a.join(b, list(KEY), "full")
    names = F.array_join(F.filter(F.array(*[F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), f) for f in fields]), lambda x: x.isNotNull()), ",")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(names != "", "changed")
    return both.select(*KEY, change.alias("change"), F.when(change == "changed", names).alias("fields")).filter(F.col("change").isNotNull())


def comment_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns whose comment differs, and whether only in line ends."""
    both = old.select(*KEY, F.col("comment").alias("a")).join(new.select(*KEY, F.col("comment").alias("b")), list(KEY)).filter(~F.col("a").eqNullSafe(F.col("b")))
    plain = lambda c: F.replace(F.col(c), F.lit("\r\n"), F.lit("\n"))
    return both.withColumn("line_ends_only", F.coalesce(plain("a") == plain("b"), F.lit(False)))


def index_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """kind, table, column, before, after: all that differs between two indexes (table, column, type, comment, table_comment).

    Kinds: added_table, removed_table, changed_table_comment (column null; comments), added_column, removed_column,
    changed_type (types), changed_comment, line_ends_only (comments). Comments are compared with all line ends alike."""
    ends = lambda c: F.regexp_replace(c, "\r\n?", "\n")
    tables = lambda df, name: df.groupBy("table").agg(F.max(ends(F.col("table_comment"))).alias(name), F.lit(True).alias(f"_{name}"))
    t = tables(old, "before").join(tables(new, "after"), "table", "full")
    kind = F.when(F.col("_before").isNull(), "added_table").when(F.col("_after").isNull(), "removed_table").when(~F.col("before").eqNullSafe(F.col("after")), "changed_table_comment")
    of_tables = t.select(kind.alias("kind"), "table", F.lit(None).cast("string").alias("column"), "before", "after").filter("kind IS NOT NULL")
    side = lambda df, name: df.select(*KEY, F.struct("type", "comment").alias(name))
    c = side(old, "o").join(side(new, "n"), list(KEY), "full")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    row = lambda k, a, b: F.struct(F.lit(k).alias("kind"), a.alias("before"), b.alias("after"))
    o, n, none = F.col("o.comment"), F.col("n.comment"), F.lit(None).cast("string")
    same = ends(o).eqNullSafe(ends(n))
    found = F.array(F.when(F.col("o").isNull(), row("added_column", none, F.col("n.type"))), F.when(F.col("n").isNull(), row("removed_column", F.col("o.type"), none)), F.when(both & (F.col("o.type") != F.col("n.type")), row("changed_type", F.col("o.type"), F.col("n.type"))),
                    F.when(both & ~same, row("changed_comment", ends(o), ends(n))), F.when(both & same & ~o.eqNullSafe(n), row("line_ends_only", o, n)))
    of_columns = c.select(*KEY, F.explode(F.array_compact(found)).alias("x")).select("x.kind", *KEY, "x.before", "x.after")
    return of_tables.unionByName(of_columns)


def inherit(new: DataFrame, baseline: DataFrame, changes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """new with the baseline's semantic fields where its own are null, for tables without removed or changed columns."""
    broken = changes.filter("change <> 'added'").select("table").distinct()
    usable = baseline.join(broken, "table", "left_anti").select(*KEY, *[F.col(f).alias(f"_{f}") for f in fields])
    return new.join(usable, list(KEY), "left").withColumns({f: F.coalesce(f, f"_{f}") for f in fields}).drop(*[f"_{f}" for f in fields])


def first_match(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern that is found in text."""
    found = None
    for pattern, label in rules:
        found = (F if found is None else found).when(text.rlike(pattern), label)
    return found.otherwise(other)


def scope(tables: DataFrame, exact: list[str], prefixes: list[str], patterns: list[str], deferred: list[str], baseline: list[str]) -> DataFrame:
    """Why a table is in or out: baseline, exact, prefix, pattern, deferred, or review."""
    t, by_prefix = F.col("table"), F.lit(False)
    for p in prefixes:
        by_prefix = by_prefix | F.startswith(t, F.lit(p))
    by_pattern = F.lit(False)
    for p in patterns:
        by_pattern = by_pattern | t.rlike(p)
    return tables.withColumn("scope", F.when(t.isin(baseline), "baseline").when(t.isin(exact), "exact").when(by_prefix, "prefix").when(by_pattern, "pattern").when(t.isin(deferred), "deferred").otherwise("review"))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """How many rows of child have a key that parent lacks, and how many keys those are."""
    keys = parent.select(F.col(parent_key).alias("_k"))
    left = child.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_k"), "left_anti")
    return left.agg(F.count("*").alias("rows"), F.count_distinct(child_key).alias("keys"))


def representatives(tables: DataFrame) -> DataFrame:
    """One table of each domain: facts before others, those with rows before empty ones, then the fewest rows, then name."""
    order = F.struct(F.col("role") != "fact", F.col("n") == 0, "n", "table")
    return tables.groupBy("domain").agg(F.min_by("table", order).alias("table"))


def same_keys(*sides: DataFrame) -> DataFrame:
    """Keys that are not on every side, with the sides that have them."""
    rows = None
    for i, side in enumerate(sides):
        own = side.select(*KEY).distinct().withColumn("side", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set(F.col("side").cast("string"))), ",").alias("sides"), F.count("*").alias("n")).filter(F.col("n") < len(sides)).drop("n")


def ddl(metadata: DataFrame) -> DataFrame:
    """A CREATE TABLE text per table, its columns in order, with comments."""
    line = F.concat(F.lit("  "), F.col("column"), F.lit(" "), F.col("type"), F.when(F.col("comment").isNotNull(), F.concat(F.lit(" COMMENT '"), F.replace(F.col("comment"), F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(""))
    lines = F.array_sort(F.collect_list(F.struct(F.col("ordinal_position").alias("i"), line.alias("line"))))
    return metadata.groupBy("table").agg(F.concat(F.lit("CREATE TABLE "), F.first("table"), F.lit(" (\n"), F.array_join(F.transform(lines, lambda x: x["line"]), ",\n"), F.lit("\n)")).alias("ddl"))


# --- bindings: metadata made from rows of part and nation


def _columns(s: SparkSession, d: str, shift: int) -> DataFrame:
    p, k = table(s, d, "part"), F.col("p_partkey") + shift
    return p.filter(k % 10 != shift).select(
        F.concat(F.lit("t"), (F.col("p_partkey") % 40).cast("string")).alias("table"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("column"),
        F.when((k % 7 == 0) & (shift > 0), "string").otherwise("int").alias("type"), (F.col("p_size") % 2 == 0).alias("nullable"),
        F.when(F.col("p_size") > 25 + shift, F.concat(F.col("p_name"), F.lit("\r\n" if shift else "\n"))).alias("comment"), F.col("p_partkey").cast("int").alias("ordinal_position"))


def _sql_columns(shift: int) -> str:
    end = "chr(13) || chr(10)" if shift else "chr(10)"
    kind = f"CASE WHEN (p_partkey + {shift}) % 7 = 0 THEN 'string' ELSE 'int' END" if shift else "'int'"
    return f"SELECT concat('t', p_partkey % 40) AS t, concat('c', p_partkey) AS c, {kind} AS type, p_size % 2 = 0 AS nullable, CASE WHEN p_size > {25 + shift} THEN p_name || {end} END AS comment FROM part WHERE (p_partkey + {shift}) % 10 <> {shift}"


_BOTH = f"WITH a AS ({_sql_columns(0)}), b AS ({_sql_columns(3)}) "
register("D2_comment_diff", lambda s, d: comment_diff(_columns(s, d, 0), _columns(s, d, 3)).groupBy("line_ends_only").agg(F.count("*").alias("n")),
         _BOTH + "SELECT coalesce(replace(a.comment, chr(13), '') = replace(b.comment, chr(13), ''), false) AS line_ends_only, count(*) AS n FROM a JOIN b ON a.t = b.t AND a.c = b.c WHERE a.comment IS DISTINCT FROM b.comment GROUP BY 1")
_commented = lambda s, d, shift: _columns(s, d, shift).filter(F.col("table") != F.lit(f"t{shift}")).withColumn("table_comment", F.concat(F.lit("about "), F.when(F.substring("table", 2, 3).cast("int") % 4 == 0, F.lit(str(shift))).otherwise(F.col("table"))))
register("D2_index_diff", lambda s, d: index_diff(_commented(s, d, 0), _commented(s, d, 3)), _BOTH + """
, x AS (SELECT * FROM a WHERE t <> 't0'), y AS (SELECT * FROM b WHERE t <> 't3'), tx AS (SELECT DISTINCT t FROM x), ty AS (SELECT DISTINCT t FROM y)
SELECT CASE WHEN tx.t IS NULL THEN 'added_table' WHEN ty.t IS NULL THEN 'removed_table' ELSE 'changed_table_comment' END AS kind, coalesce(tx.t, ty.t) AS "table", NULL AS "column",
  CASE WHEN tx.t IS NOT NULL THEN CASE WHEN CAST(substr(tx.t, 2) AS INTEGER) % 4 = 0 THEN 'about 0' ELSE 'about ' || tx.t END END AS before, CASE WHEN ty.t IS NOT NULL THEN CASE WHEN CAST(substr(ty.t, 2) AS INTEGER) % 4 = 0 THEN 'about 3' ELSE 'about ' || ty.t END END AS after
FROM tx FULL JOIN ty ON tx.t = ty.t WHERE tx.t IS NULL OR ty.t IS NULL OR CAST(substr(tx.t, 2) AS INTEGER) % 4 = 0
UNION ALL SELECT 'added_column', y.t, y.c, NULL, y.type FROM y ANTI JOIN x ON x.t = y.t AND x.c = y.c UNION ALL SELECT 'removed_column', x.t, x.c, x.type, NULL FROM x ANTI JOIN y ON x.t = y.t AND x.c = y.c
UNION ALL SELECT 'changed_type', x.t, x.c, x.type, y.type FROM x JOIN y ON x.t = y.t AND x.c = y.c WHERE x.type <> y.type
UNION ALL SELECT CASE WHEN same THEN 'line_ends_only' ELSE 'changed_comment' END, t, c, CASE WHEN same THEN o ELSE replace(o, chr(13), '') END, CASE WHEN same THEN n ELSE replace(n, chr(13), '') END
  FROM (SELECT x.t, x.c, x.comment AS o, y.comment AS n, replace(x.comment, chr(13), '') IS NOT DISTINCT FROM replace(y.comment, chr(13), '') AS same FROM x JOIN y ON x.t = y.t AND x.c = y.c) WHERE o IS DISTINCT FROM n""")
register("D3_structure_diff", lambda s, d: diff(_columns(s, d, 0), _columns(s, d, 3), ("type", "nullable")), _BOTH + """
SELECT coalesce(a.t, b.t) AS "table", coalesce(a.c, b.c) AS "column", CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN a.c IS NOT NULL AND b.c IS NOT NULL THEN 'type' END AS fields
FROM a FULL JOIN b ON a.t = b.t AND a.c = b.c WHERE a.c IS NULL OR b.c IS NULL OR a.type <> b.type OR a.nullable <> b.nullable""")
register("D4_inherited", lambda s, d: inherit(_columns(s, d, 3), _columns(s, d, 0), diff(_columns(s, d, 0), _columns(s, d, 3), ("type",)), ("comment",)).agg(F.count("*").alias("n"), F.count("comment").alias("commented")), _BOTH + """
, broken AS (SELECT DISTINCT a.t FROM a LEFT JOIN b ON a.t = b.t AND a.c = b.c WHERE b.c IS NULL OR a.type <> b.type)
SELECT count(*) AS n, count(coalesce(b.comment, u.comment)) AS commented FROM b LEFT JOIN (SELECT a.* FROM a ANTI JOIN broken x ON a.t = x.t) u ON b.t = u.t AND b.c = u.c""")
register("D5_schema_fingerprint", lambda s, d: _columns(s, d, 0).groupBy("table").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "column", "type", F.col("nullable").cast("string")))), "\n"), 256).alias("fingerprint")),
         _BOTH + "SELECT t AS \"table\", sha256(string_agg(concat(c, '|', type, '|', nullable), chr(10) ORDER BY concat(c, '|', type, '|', nullable))) AS fingerprint FROM a GROUP BY t")
register("D6_scope", lambda s, d: scope(_columns(s, d, 0).select("table").distinct(), ["t1", "t2"], ["t3"], ["^t[45]$"], ["t6"], ["t2"]),
         _BOTH + "SELECT DISTINCT t AS \"table\", CASE WHEN t = 't2' THEN 'baseline' WHEN t = 't1' THEN 'exact' WHEN t LIKE 't3%' THEN 'prefix' WHEN t IN ('t4', 't5') THEN 'pattern' WHEN t = 't6' THEN 'deferred' ELSE 'review' END AS scope FROM a")
_RULES = [("log|audit", "J"), ("dict|code", "C"), ("^(red|blue)", "A"), ("bolt|ring", "B")]
register("D7_classes", lambda s, d: table(s, d, "part").select("p_partkey", first_match(F.col("p_name"), _RULES, "other").alias("class")),
         "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'log|audit') THEN 'J' WHEN regexp_matches(p_name, 'dict|code') THEN 'C' WHEN regexp_matches(p_name, '^(red|blue)') THEN 'A' WHEN regexp_matches(p_name, 'bolt|ring') THEN 'B' ELSE 'other' END AS class FROM part")
register("D8_domains", lambda s, d: table(s, d, "part").select(first_match(F.lower("p_type"), [("econ", "cheap"), ("promo|small", "promotion")], "none").alias("domain")).groupBy("domain").count().withColumnRenamed("count", "n"),
         "SELECT CASE WHEN lower(p_type) LIKE '%econ%' THEN 'cheap' WHEN regexp_matches(lower(p_type), 'promo|small') THEN 'promotion' ELSE 'none' END AS domain, count(*) AS n FROM part GROUP BY 1")
register("D9_inventory", lambda s, d: _columns(s, d, 0).groupBy("table").agg(F.count("*").alias("columns"), F.count_if("nullable").alias("nullable"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("comment").isNotNull(), F.col("column")))), ",").alias("commented")),
         _BOTH + "SELECT t AS \"table\", count(*) AS columns, count(*) FILTER (nullable) AS nullable, coalesce(string_agg(c, ',' ORDER BY c) FILTER (comment IS NOT NULL), '') AS commented FROM a GROUP BY t")
register("D10_orphans", lambda s, d: orphans(table(s, d, "lineitem"), "l_orderkey", table(s, d, "orders").filter("o_orderstatus = 'F'"), "o_orderkey"),
         "SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS keys FROM lineitem l ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON l.l_orderkey = o.o_orderkey")
register("D11_representatives", lambda s, d: representatives(table(s, d, "part").select(F.col("p_brand").alias("domain"), F.concat(F.lit("p"), "p_partkey").alias("table"), F.when(F.col("p_size") % 3 == 0, "fact").otherwise("other").alias("role"), F.when(F.col("p_size") > 20, F.col("p_size")).otherwise(0).alias("n"))),
         "SELECT domain, t AS \"table\" FROM (SELECT p_brand AS domain, concat('p', p_partkey) AS t, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3 <> 0, p_size <= 20, CASE WHEN p_size > 20 THEN p_size ELSE 0 END, concat('p', p_partkey)) AS k FROM part) WHERE k = 1")
register("D12_scope_counts", lambda s, d: _columns(s, d, 0).agg(F.count_distinct("table").alias("tables"), F.count_distinct(*KEY).alias("columns"), F.count_if("nullable").alias("included"), F.count_if(~F.col("nullable")).alias("excluded")),
         _BOTH + "SELECT count(DISTINCT t) AS tables, count(DISTINCT (t, c)) AS columns, count(*) FILTER (nullable) AS included, count(*) FILTER (NOT nullable) AS excluded FROM a")
register("D13_default_scope", lambda s, d: _columns(s, d, 0).groupBy("table").agg(F.count_if("nullable").alias("q"), F.max("ordinal_position").alias("n")).select("table", F.when(F.col("q") == 0, "no column").when(F.col("n") < 500, "no data").otherwise("usable").alias("reason")),
         "WITH a AS (SELECT p_partkey, concat('t', p_partkey % 40) AS t, p_size % 2 = 0 AS nullable FROM part WHERE p_partkey % 10 <> 0) SELECT t AS \"table\", CASE WHEN count(*) FILTER (nullable) = 0 THEN 'no column' WHEN max(p_partkey) < 500 THEN 'no data' ELSE 'usable' END AS reason FROM a GROUP BY t")
register("D14_compatible", lambda s, d: _columns(s, d, 0).select(*KEY, F.col("type").alias("a")).join(_columns(s, d, 3).select(*KEY, F.col("type").alias("b")), list(KEY), "left").groupBy("table").agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("compatible")),
         _BOTH + "SELECT a.t AS \"table\", bool_and(coalesce(a.type = b.type, false)) AS compatible FROM a LEFT JOIN b ON a.t = b.t AND a.c = b.c GROUP BY 1")
register("D15_ddl", lambda s, d: ddl(_columns(s, d, 0)),
         "WITH a AS (SELECT p_partkey AS i, concat('t', p_partkey % 40) AS t, concat('c', p_partkey) AS c, CASE WHEN p_size > 25 THEN p_name || chr(10) END AS comment FROM part WHERE p_partkey % 10 <> 0) SELECT t AS \"table\", concat('CREATE TABLE ', t, ' (', chr(10), string_agg(concat('  ', c, ' int', CASE WHEN comment IS NOT NULL THEN ' COMMENT ''' || comment || '''' ELSE '' END), ',' || chr(10) ORDER BY i), chr(10), ')') AS ddl FROM a GROUP BY t")
register("D17_key_equality", lambda s, d: same_keys(_columns(s, d, 0), _columns(s, d, 3), _columns(s, d, 0).filter("nullable")),
         _BOTH + ", k AS (SELECT t, c, '0' AS s FROM a UNION SELECT t, c, '1' FROM b UNION SELECT t, c, '2' FROM a WHERE nullable) SELECT t AS \"table\", c AS \"column\", string_agg(s, ',' ORDER BY s) AS sides FROM k GROUP BY 1, 2 HAVING count(*) < 3")
