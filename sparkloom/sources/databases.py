"""Databases as sources: guarded texts in read-only transactions, scans in even partitions, metadata with keys."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import METADATA

#: Statements that make a session read-only, by the kind of database in a url. Others, Derby among them, are
#: read-only by their connection or user.
READ_ONLY = {"postgresql": "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY", "mysql": "SET SESSION TRANSACTION READ ONLY"}
#: Statements that bound how long a statement, and its wait for a lock, may take, in milliseconds.
TIMEOUTS = {"postgresql": "SET statement_timeout = {0}; SET lock_timeout = {1}", "mysql": "SET SESSION max_execution_time = {0}, innodb_lock_wait_timeout = {2}"}
#: Rows that a probe gives at most.
PROBED = 1000


class Refused(Exception):
    """A text that is no query, or that the database would not run in a read-only transaction."""


@dataclass(frozen=True)
class Database:
    """url of JDBC, driver class, and properties (user, password). seconds: how long a statement may take."""

    url: str
    driver: str = ""
    properties: dict[str, str] = field(default_factory=dict, hash=False)
    seconds: int = 30
    lock_seconds: int = 5
    fetch: int = 10_000

    @property
    def kind(self) -> str:
        return self.url.split(":")[1]

    def options(self) -> dict[str, str]:
        """Options of Spark's reader: each session that an executor opens is read-only and bounded."""
        first = [READ_ONLY[self.kind]] if self.kind in READ_ONLY else []
        if self.kind in TIMEOUTS:
            first.append(TIMEOUTS[self.kind].format(self.seconds * 1000, self.lock_seconds * 1000, self.lock_seconds))
        out = {"url": self.url, "queryTimeout": str(self.seconds), "fetchsize": str(self.fetch), **self.properties}
        if self.driver:
            out["driver"] = self.driver
        if first:
            out["sessionInitStatement"] = "; ".join(first)
        return out


def _query(sql: str) -> str:
    """A text that is one query, without its last semicolon."""
    text = re.sub(r"(?s)/\*.*?\*/|--[^\n]*", " ", sql).strip().rstrip(";").strip()
    if not re.match(r"(?i)\(*\s*(select|with)\b", text):
        raise Refused("only SELECT is allowed")
    return sql.strip().rstrip(";").strip()


def run_sql(spark: SparkSession, db: Database, sql: str) -> DataFrame:
    """The result of a query that the database runs as a whole: its filters, joins and aggregates stay there.

    Columns are kept where no row comes. A text that isn't a query raises Refused before anything runs; what slips through
    is refused by the read-only session. The rows come through one connection: for large results take scan().
    """
    return spark.read.format("jdbc").options(**db.options()).option("query", _query(sql)).load()


def bounds(spark: SparkSession, db: Database, table: str, column: str, partitions: int, error: float = 0.01) -> list:
    """Values that part a numeric or time column into ranges of about equal numbers of rows: one pass over that column
    alone, in ranges of equal width between its ends, and quantiles of it; so a skewed key gives even partitions too."""
    ends = run_sql(spark, db, f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}").first()
    if ends[0] is None or ends[0] == ends[1] or partitions < 2:
        return []
    spread = {"partitionColumn": column, "lowerBound": str(ends[0]), "upperBound": str(ends[1]), "numPartitions": str(partitions)}
    values = spark.read.format("jdbc").options(**db.options()).option("dbtable", f"(SELECT {column} FROM {table}) q").options(**spread).load()
    kind = values.schema[0].dataType
    number = F.unix_micros(values.columns[0]) if isinstance(kind, T.TimestampType) else F.unix_date(values.columns[0]) if isinstance(kind, T.DateType) else F.col(values.columns[0])
    found = values.select(F.percentile_approx(number, [k / partitions for k in range(1, partitions)], int(1 / error)).alias("q")).select(F.explode(F.array_distinct("q")).alias("q"))
    if isinstance(kind, T.TimestampType):
        found = found.select(F.timestamp_micros("q").cast("string"))
    elif isinstance(kind, T.DateType):
        found = found.select(F.date_from_unix_date(F.col("q").cast("int")).cast("string"))
    return [r[0] for r in found.collect()]  # partitions - 1 values at most


def _literal(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def scan(spark: SparkSession, db: Database, table: str, column: str | None = None, partitions: int = 8) -> DataFrame:
    """A table, read by several connections at once: a partition for each range of `column`, and one for its nulls.

    Filters and the choice of columns on the result go into the database's statements. Without a column, or with one that has
    a single value, one connection reads all.
    """
    cuts = bounds(spark, db, table, column, partitions) if column else []
    if not cuts:
        return spark.read.format("jdbc").options(**db.options()).option("dbtable", table).load()
    marks = list(map(_literal, cuts))
    parts = [f"{column} < {marks[0]}", *(f"{column} >= {a} AND {column} < {b}" for a, b in zip(marks, marks[1:])), f"{column} >= {marks[-1]}", f"{column} IS NULL"]
    return spark.read.jdbc(db.url, table, predicates=parts, properties={k: v for k, v in db.options().items() if k != "url"})


class _Connection:
    """A connection of the driver, read-only and without commit; what it did is rolled back at its end."""

    def __init__(self, spark: SparkSession, db: Database):
        self.jvm, self.db = spark._jvm, db

    def __enter__(self):
        properties = self.jvm.java.util.Properties()
        for k, v in self.db.properties.items():
            properties.setProperty(k, v)
        if self.db.driver:
            self.jvm.java.lang.Class.forName(self.db.driver)
        self.open = self.jvm.java.sql.DriverManager.getConnection(self.db.url, properties)
        self.open.setReadOnly(True)
        self.open.setAutoCommit(False)
        return self.open

    def __exit__(self, *_) -> None:
        self.open.rollback()
        self.open.close()


def probe(spark: SparkSession, db: Database, sql: str, most: int = PROBED) -> dict:
    """columns, and at most `most` rows as text, of a text that the driver runs in a read-only transaction, rolled back at
    its end. A write is refused by the database, and raises Refused with its message."""
    with _Connection(spark, db) as connection:
        statement = connection.createStatement()
        statement.setQueryTimeout(db.seconds)
        statement.setMaxRows(most)
        try:
            if not statement.execute(sql):
                raise Refused("not a query")
            rows, facts = [], statement.getResultSet().getMetaData()
            names, result = [facts.getColumnLabel(k + 1) for k in range(facts.getColumnCount())], statement.getResultSet()
            while result.next():
                rows.append(tuple(result.getString(k + 1) for k in range(len(names))))
            return {"columns": names, "rows": rows}
        except Py4JJavaError as e:
            raise Refused(e.java_exception.getMessage()) from e
        finally:
            statement.close()


def metadata(spark: SparkSession, db: Database, schema: str | None = None, kinds: Iterable[str] = ("TABLE", "VIEW")) -> tuple[DataFrame, DataFrame]:
    """Metadata rows of all tables of a schema, and index entries (schema, table, index, unique, primary, method, column,
    position, direction), from the database's own catalogue; no data is read.

    Where a table's keys or indexes can't be read it has none; its columns stay. A row a column of the catalogue.
    """
    def rows(result, *names: str) -> list[tuple]:
        found = []
        while result.next():
            found.append(tuple(result.getString(n) for n in names))
        result.close()
        return found

    with _Connection(spark, db) as connection:
        facts, gateway = connection.getMetaData(), spark.sparkContext._gateway
        wanted = gateway.new_array(gateway.jvm.java.lang.String, len(kinds := list(kinds)))
        for i, k in enumerate(kinds):
            wanted[i] = k
        tables = {(s, t): (kind, remark) for s, t, kind, remark in rows(facts.getTables(None, schema, "%", wanted), "TABLE_SCHEM", "TABLE_NAME", "TABLE_TYPE", "REMARKS")}
        columns = rows(facts.getColumns(None, schema, "%", "%"), "TABLE_SCHEM", "TABLE_NAME", "COLUMN_NAME", "TYPE_NAME", "REMARKS", "IS_NULLABLE", "ORDINAL_POSITION")
        keys: set[tuple] = set()
        entries = []
        for s, t in tables:
            try:
                own = rows(facts.getPrimaryKeys(None, s, t), "COLUMN_NAME", "PK_NAME")
                keys |= {(s, t, c) for c, _ in own}
                primary = {name for _, name in own} | {tuple(sorted(c for c, _ in own))}
                listed = rows(facts.getIndexInfo(None, s, t, False, True), "INDEX_NAME", "NON_UNIQUE", "TYPE", "COLUMN_NAME", "ORDINAL_POSITION", "ASC_OR_DESC")
                of = {i: tuple(sorted(c for n, _, _, c, *_ in listed if n == i)) for i, *_ in listed}
                entries += [(s, t, i, plain in ("0", "f", "false"), plain in ("0", "f", "false") and (i in primary or of[i] in primary), {"1": "clustered", "2": "hash"}.get(method, "btree"), c, int(at), {"A": "asc", "D": "desc"}.get(way))
                            for i, plain, method, c, at, way in listed if i and c]
            except Py4JJavaError:  # a right that is missing leaves the table without keys
                continue
    found = [(s, t, {"BASE TABLE": "table"}.get(tables[s, t][0], tables[s, t][0].lower()), tables[s, t][1] or None, c, kind.lower(), remark or None, null != "NO", (s, t, c) in keys, int(at))
             for s, t, c, kind, remark, null, at in columns if (s, t) in tables]
    shape = "schema string, table string, index string, unique boolean, primary boolean, method string, column string, position int, direction string"
    return spark.createDataFrame(found, METADATA), spark.createDataFrame(entries, shape)
