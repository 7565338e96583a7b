import pytest

from sparkloom.plans import guard
from sparkloom.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def views(spark):
    tables.register(spark, SF, ("customer", "orders", "nation"))
    spark.createDataFrame([(1, 2)], "id int, value int").createOrReplaceTempView("t")
    spark.createDataFrame([(1, 2)], "id int, code int").createOrReplaceTempView("u")


CASES = [
    ("SELECT id, value FROM t", True), ("SELECT id FROM nowhere", False), ("SELECT nothing FROM t", False), ("SELECT id FROM t WHERE nothing = 1", False), ("SELECT id FROM t ORDER BY nothing", False),
    ("SELECT count(id) AS n FROM t GROUP BY nothing", False), ("SELECT t.id FROM t JOIN u ON t.id = u.nothing", False), ("DELETE FROM t", False), ("SELECT id FROM t; DROP TABLE t", False), ("SELECT id FROM t; SELECT id FROM u", False),
    ("SELECT relname FROM pg_class", False), ("SELECT id FROM t WHERE id IN (SELECT id FROM u)", True), ("SELECT id FROM t WHERE id IN (SELECT nothing FROM u)", False), ("WITH c AS (SELECT id FROM t) SELECT id FROM c", True),
    ("SELECT d.id FROM (SELECT id FROM t) d", True), ("SELECT count(*) AS n FROM t", True), ("SELECT count( * ) AS n FROM t", True), ("SELECT * FROM t", False), ("SELECT t.* FROM t", False), ("SELECT `t`.* FROM t", False),
    ("SELECT id * value AS p FROM t", True), ("SELECT id FROM t JOIN u ON t.id = u.id", False), ("SELECT id FROM t -- DROP\n", True), ("SELECT max(id) AS comment FROM t", False), ("EXPLAIN SELECT id FROM t", False),
]


@pytest.mark.parametrize("sql,passes", CASES)
def test_cases(spark, sql, passes):
    assert guard.check(spark, sql).passed == passes, guard.check(spark, sql).errors


def test_reasons(spark):
    assert guard.check(spark, "SELECT id FROM t JOIN u ON t.id = u.id").errors[0].startswith("ambiguous column")
    assert guard.check(spark, "SELECT x FROM t").errors[0].startswith("unknown column")
    assert guard.check(spark, "SELECT x FROM gone").errors == ["unknown table: gone"]
    assert guard.check(spark, "SELECT id FROM t", candidates={"u"}).severity == "warning"
    assert not guard.check(spark, "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-01-01'", half_open={"o_orderdate"}).passed
    assert guard.check(spark, "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'", half_open={"o_orderdate"}).passed
    with pytest.raises(guard.Blocked):
        guard.guarded_sql(spark, "UPDATE t SET id = 1")


def test_lineage(spark):
    found = guard.check(spark, "WITH s AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c.c_name AS name, s.total + c.c_acctbal AS sum FROM customer c JOIN s ON s.k = c.c_custkey")
    assert found.lineage["sum"] >= {("orders", "o_totalprice")} or {x[1] for x in found.lineage["sum"]} == {"o_totalprice", "c_acctbal"}
    assert {x[1] for x in found.lineage["name"]} == {"c_name"}


def test_admissible(spark):
    assert guard.admissible(spark, "SELECT id FROM t LIMIT 5") and guard.admissible(spark, "SELECT count(*) AS n FROM t")
    assert not guard.admissible(spark, "SELECT id FROM t") and not guard.admissible(spark, "SELECT * FROM t LIMIT 5")


def test_literals_run_as_they_are(spark):
    assert guard.guarded_sql(spark, "SELECT 'x  y' AS a, 'p--q' AS b, '/* c */' AS c -- d\nFROM t").first().asDict() == {"a": "x  y", "b": "p--q", "c": "/* c */"}
    assert guard.check(spark, "SELECT  'a  ;' AS x -- why\n FROM t ;").sql == "SELECT 'a  ;' AS x FROM t"


def test_time_ranges_are_read_from_the_plan(spark):
    closed = lambda where: not guard.check(spark, f"SELECT o_orderkey FROM orders WHERE {where}", half_open={"o_orderdate"}).passed
    assert closed("TIMESTAMP '1995-01-01' >= o_orderdate") and closed("o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-01-01'") and closed("date(o_orderdate) <= DATE '1995-01-01'")
    assert not closed("o_orderdate >= DATE '1995-01-01'") and not closed("o_orderstatus = 'o_orderdate <= x'") and not closed("DATE '1995-01-01' <= o_orderdate")


def test_names_of_several_schemas(spark):
    tables = {"public.t", "other.t", "public.u"}
    assert guard.check(spark, "SELECT id FROM t", tables=tables).errors == ["ambiguous table: t"]
    assert guard.check(spark, "SELECT id FROM u", tables=tables).passed
    assert "unknown table: third.u" in guard.check(spark, "SELECT id FROM third.u", tables=tables).errors


def test_business_rules(spark):
    bans = (guard.Ban("trend|change", frozenset({"u"}), "no thresholds for trends"), guard.Ban("trace", frozenset({"t"}), "traces need more than t", alone=True))
    assert guard.check(spark, "SELECT id FROM u", question="the tr end", bans=bans).errors == ["no thresholds for trends"]
    assert guard.check(spark, "SELECT id FROM t", question="trace it", bans=bans).errors == ["traces need more than t"]
    assert guard.check(spark, "SELECT t.id FROM t JOIN u ON t.id = u.id", question="trace it", bans=bans).passed
    assert guard.check(spark, "SELECT id FROM u", question="which ones", bans=bans).passed


@pytest.mark.parametrize("sql", [
    "SELECT java_method('java.lang.System', 'getProperty', 'user.dir') AS x FROM t", "SELECT reflect('java.lang.System', 'nanoTime') AS x FROM t", "SELECT id FROM range(5)", "SELECT id FROM t WHERE id IN (SELECT id FROM range(5))",
    "SELECT input_file_name() AS x FROM t", "SELECT current_user() AS x FROM t", "SELECT id FROM t WHERE raise_error('x') IS NULL", "SELECT mine(id) AS x FROM t", "SELECT max(reflect('java.lang.System', 'nanoTime')) AS x FROM t",
    "SELECT id FROM t ORDER BY try_reflect('java.lang.System', 'nanoTime')", "SELECT word FROM sql_keywords() k(word, reserved)", "WITH c AS (SELECT version() AS v FROM t) SELECT v FROM c", "SELECT db.f(id) AS x FROM t"])
def test_functions_that_reach_outside(spark, sql):
    spark.udf.register("mine", lambda x: x)
    assert [e for e in guard.check(spark, sql).errors if e.startswith("function not allowed")], guard.check(spark, sql)


@pytest.mark.parametrize("sql", [
    "SELECT avg(id) AS a, count(*) AS n, round(max(value), 3) AS m FROM t", "SELECT coalesce(id, 0) AS a, date_trunc('day', current_date()) AS d FROM t", "SELECT x FROM t LATERAL VIEW explode(array(id, value)) v AS x",
    "SELECT v.x FROM t, LATERAL explode(array(t.id, t.value)) v(x)", "SELECT CASE WHEN id BETWEEN 1 AND 3 THEN 'a' ELSE lower('B') END AS c FROM t", "SELECT id FROM t WHERE id IN (SELECT id FROM u WHERE abs(id) > 0)", "SELECT row_number() OVER (ORDER BY id) AS r FROM t"])
def test_plain_functions(spark, sql):
    assert guard.check(spark, sql).passed, guard.check(spark, sql).errors


def test_functions_that_are_allowed_by_name(spark):
    spark.udf.register("mine", lambda x: x)
    assert guard.check(spark, "SELECT mine(id) AS x FROM t", functions={"MINE"}).passed
