"""Read-only sessions: what may run, and what happens to a slow statement."""

import threading
import time

import pytest

from sparkloom.plans import session


@pytest.fixture(scope="module", autouse=True)
def views(spark):
    spark.range(100).selectExpr("id", "id % 7 AS value").createOrReplaceTempView("small")
    spark.range(0, 10**14, 1, 8).selectExpr("id").createOrReplaceTempView("large")


SLOW = "SELECT count(*) AS n FROM large WHERE id % 7 = 3"


@pytest.mark.parametrize("sql", ["INSERT INTO small VALUES (1, 2)", "CREATE TABLE x AS SELECT 1 AS a", "DROP TABLE small", "SET spark.sql.ansi.enabled=false", "SHOW TABLES", "DESCRIBE small", "CACHE TABLE small", "EXPLAIN SELECT id FROM small",
                                 "REFRESH TABLE small", "ANALYZE TABLE small COMPUTE STATISTICS", "USE default", "FROM small INSERT INTO small SELECT id, value", "SELECT id FROM", "SELECT nothing FROM small", "SELECT reflect('java.lang.System', 'nanoTime') AS x FROM small"])
def test_only_queries_run(spark, sql):
    facts = session.ReadOnlySession(spark).run(sql)
    assert facts.state == "blocked" and not facts.success and facts.message and not facts.rows


def test_commands_are_known_from_their_plans(spark):
    assert session.changes(spark, "SET x=1") and session.changes(spark, "INSERT INTO small SELECT id, value FROM small") and session.changes(spark, "TRUNCATE TABLE small")
    assert not session.changes(spark, "SELECT id FROM small") and not session.changes(spark, "WITH c AS (SELECT id FROM small) SELECT id FROM c UNION SELECT value FROM small")


def test_facts_of_a_query(spark):
    facts = session.ReadOnlySession(spark, most_rows=5).run("SELECT id, value FROM small WHERE id < 50 ORDER BY id")
    assert facts.success and facts.row_count == 5 and facts.columns == ["id", "value"] and facts.rows[4] == (4, 4) and facts.tables == ["small"]
    none = session.ReadOnlySession(spark).run("SELECT id FROM small WHERE id < 0")
    assert none.success and none.row_count == 0 and none.columns == ["id"]
    failed = session.ReadOnlySession(spark).run("SELECT CAST('x' AS INT) AS a FROM small")
    assert failed.state == "failed" and not failed.success


def test_a_slow_statement_is_timed_out_while_others_go_on(spark):
    own, found = session.ReadOnlySession(spark, seconds=30), {}

    def slow():
        found["slow"] = own.run(SLOW, seconds=2)

    thread = threading.Thread(target=slow)
    thread.start()
    while thread.is_alive():
        found.setdefault("others", []).append(own.run("SELECT count(*) AS n FROM small"))
        time.sleep(0.2)
    thread.join()
    assert found["slow"].state == "timed_out" and 2 <= found["slow"].seconds < 25
    assert not [f for f in found["others"] if f.rows != [(100,)]] and not own.running


def test_a_statement_is_cancelled_by_its_tag(spark):
    own, found = session.ReadOnlySession(spark, seconds=60), {}
    thread = threading.Thread(target=lambda: found.update(slow=own.run(SLOW, tag="mine")))
    thread.start()
    time.sleep(3)
    while thread.is_alive():
        own.cancel("mine")
        time.sleep(0.2)
    assert found["slow"].state == "cancelled" and found["slow"].seconds < 40
