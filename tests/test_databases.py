"""Database sources, on an embedded Derby database."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import databases, tables

SF = "/root/testdata/sf0.001"
DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def db(spark):
    owner = {"user": "owner", "password": "x"}
    url = "jdbc:derby:memory:loom"
    orders = tables.table(spark, SF, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    orders.toDF(*(c.upper() for c in orders.columns)).write.format("jdbc").options(url=f"{url};create=true", dbtable="ORDERS", driver=DRIVER, createTableColumnTypes="O_ORDERSTATUS VARCHAR(20), O_ORDERPRIORITY VARCHAR(40)", **owner).save()
    jvm = spark._jvm
    connection = jvm.java.sql.DriverManager.getConnection(url, *owner.values())
    for sql in ("CREATE TABLE KEYED (ID BIGINT NOT NULL PRIMARY KEY, NAME VARCHAR(20), BORN DATE, CODE INT)", "CREATE UNIQUE INDEX UX ON KEYED (NAME DESC, CODE)", "CREATE VIEW SEEN AS SELECT ID, NAME FROM KEYED",
                "INSERT INTO KEYED VALUES (1, 'a', '2024-01-01', NULL), (2, 'b', '2024-02-01', 5), (3, NULL, NULL, 5)",
                "CALL SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.database.readOnlyAccessUsers', 'reader')"):
        connection.createStatement().execute(sql)
    connection.close()
    return databases.Database(url, DRIVER, {"user": "reader", "password": "x"})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_queries_run_in_the_database(spark, db):
    found = databases.run_sql(spark, db, "SELECT O_ORDERSTATUS AS STATUS, COUNT(*) AS N FROM OWNER.ORDERS GROUP BY O_ORDERSTATUS;")
    want = tables.table(spark, SF, "orders").groupBy("o_orderstatus").count().collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want))


def test_no_rows_keep_their_columns(spark, db):
    found = databases.run_sql(spark, db, "SELECT ID, NAME FROM OWNER.KEYED WHERE ID < 0")
    assert found.columns == ["ID", "NAME"] and found.count() == 0
    assert databases.probe(spark, db, "SELECT ID, NAME FROM OWNER.KEYED WHERE ID < 0") == {"columns": ["ID", "NAME"], "rows": []}


def test_writes_are_refused(spark, db):
    with pytest.raises(databases.Refused):
        databases.run_sql(spark, db, "DELETE FROM OWNER.KEYED")
    with pytest.raises(databases.Refused, match="(?i)read.only|permission"):
        databases.probe(spark, db, "DELETE FROM OWNER.KEYED")
    owner = databases.Database(db.url, DRIVER, {"user": "owner", "password": "x"})
    with pytest.raises(databases.Refused, match="(?i)read.only"):  # one with all rights too
        databases.probe(spark, owner, "INSERT INTO OWNER.KEYED VALUES (9, 'x', NULL, NULL)")
    assert databases.probe(spark, db, "SELECT COUNT(*) AS N FROM OWNER.KEYED")["rows"] == [("3",)]


def test_scans_in_partitions_push_filters_and_columns(spark, db):
    whole = databases.scan(spark, db, "OWNER.ORDERS", "O_ORDERKEY", 6)
    assert whole.rdd.getNumPartitions() == 7
    sizes = [r["n"] for r in whole.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1500 and max(sizes) <= 2 * 1500 / 6
    few = whole.filter("O_ORDERSTATUS = 'F' AND O_TOTALPRICE > 1000").select("O_ORDERKEY")
    assert "PushedFilters: [*IsNotNull(O_ORDERSTATUS)" in plan(few) or "*EqualTo(O_ORDERSTATUS,F)" in plan(few)
    assert "ReadSchema: struct<O_ORDERKEY:bigint>" in plan(few)
    want = tables.table(spark, SF, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 1000").select("o_orderkey")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, want.collect()))


def test_partitions_are_even_on_skewed_keys_times_and_nulls(spark, db):
    rows = [(i if i < 900 else 1_000_000 * i if i < 990 else None, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * i)) for i in range(1000)]
    owner = {"user": "owner", "password": "x", "driver": DRIVER}
    spark.createDataFrame(rows, "K long, SEEN_AT timestamp").write.format("jdbc").options(url=db.url, dbtable="SKEWED", **owner).mode("overwrite").save()
    for column in ("K", "SEEN_AT"):
        found = databases.scan(spark, db, "OWNER.SKEWED", column, 5)
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 1000 and max(sizes) <= 250 and len(sizes) >= 5
        assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)
    assert databases.scan(spark, db, "OWNER.KEYED").rdd.getNumPartitions() == 1


def test_metadata_with_keys(spark, db):
    columns, entries = databases.metadata(spark, db, "OWNER")
    got = {(r["table"], r["column"]): r for r in columns.collect()}
    assert got["KEYED", "ID"]["primary_key"] and not got["KEYED", "ID"]["nullable"] and got["KEYED", "NAME"]["nullable"] and not got["KEYED", "NAME"]["primary_key"]
    assert [got["KEYED", c]["ordinal_position"] for c in ("ID", "NAME", "BORN", "CODE")] == [1, 2, 3, 4] and got["KEYED", "BORN"]["type"] == "date"
    assert got["SEEN", "ID"]["object_type"] == "view" and got["ORDERS", "O_ORDERKEY"]["object_type"] == "table"
    found = {r["index"]: r for r in tables.indexes(entries.filter("table = 'KEYED'")).collect()}
    assert [(c["name"], c["direction"]) for c in found["UX"]["columns"]] == [("NAME", "desc"), ("CODE", "asc")] and found["UX"]["unique"] and not found["UX"]["primary"]
    assert sum(r["primary"] for r in found.values()) == 1


def test_metadata_without_keys_where_they_cannot_be_read(spark, db, monkeypatch):
    from py4j.java_gateway import JavaObject

    call = JavaObject.__getattr__

    def broken(self, name):
        member = call(self, name)
        return (lambda *a: spark._jvm.java.sql.DriverManager.getConnection("jdbc:derby:memory:gone")) if name == "getPrimaryKeys" else member

    monkeypatch.setattr(JavaObject, "__getattr__", broken)
    columns, entries = databases.metadata(spark, db, "OWNER")
    monkeypatch.undo()
    assert columns.filter("primary_key").count() == 0 and columns.count() > 10 and entries.count() == 0


def test_options_of_kinds():
    pg = databases.Database("jdbc:postgresql://h/d", seconds=7, lock_seconds=2).options()
    assert pg["sessionInitStatement"] == "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY; SET statement_timeout = 7000; SET lock_timeout = 2000" and pg["queryTimeout"] == "7"
    assert "TRANSACTION READ ONLY" in databases.Database("jdbc:mysql://h/d").options()["sessionInitStatement"]
