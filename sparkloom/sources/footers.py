"""Rows, nulls and extremes of Parquet tables from their footers alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types whose extremes a footer gives.
_ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType)
SHAPE = T.StructType([T.StructField(*x) for x in (
    ("table", T.StringType()), ("column", T.StringType()), ("type", T.StringType()), ("nullable", T.BooleanType()), ("ordinal_position", T.IntegerType()), ("primary_key", T.BooleanType()),
    ("rows", T.LongType()), ("nulls", T.LongType()), ("low", T.StringType()), ("high", T.StringType()), ("error", T.StringType()))])
#: Tables whose footers are read at a time.
AT_ONCE = 8


def _session(spark: SparkSession) -> SparkSession:
    """A session whose Parquet reader answers counts and extremes from footers."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def counted(spark: SparkSession, path: str) -> DataFrame:
    """One row of a table: `rows`, and for each column c of plain type `c|n`, its values that aren't null, and `c|low` and
    `c|high` of numbers and dates. Tasks read footers only: no column is read."""
    df = _session(spark).read.parquet(path)
    made = [F.count(F.lit(1)).alias("rows")]
    for f in df.schema:
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            made.append(F.count(F.col(f"`{f.name}`")).alias(f"{f.name}|n"))
        if isinstance(f.dataType, _ORDERED):
            made += [F.min(F.col(f"`{f.name}`")).alias(f"{f.name}|low"), F.max(F.col(f"`{f.name}`")).alias(f"{f.name}|high")]
    return df.agg(*made)


def statistics(spark: SparkSession, paths: dict[str, str], keys: Callable[[str], Iterable[str]] = lambda table: ()) -> DataFrame:
    """A row for each column of each table: type, place, rows, nulls, extremes as text, and whether it is a key.

    paths: table names and where they are. keys gives a table's key columns; where it fails the table has none. A table
    that can't be read gives one row with its error, and the others are not touched. Nested columns have no nulls or
    extremes, and text no extremes, as footers hold none of them whole.
    """
    def one(name: str) -> list[tuple]:
        try:
            row = counted(spark, paths[name])
            found, schema = row.first().asDict(), _session(spark).read.parquet(paths[name]).schema
        except (PySparkException, Py4JJavaError) as e:
            return [(name, None, None, None, None, None, None, None, None, None, str(e).strip().splitlines()[0][:300])]
        try:
            own = set(keys(name))
        except Exception:  # whatever a catalogue answers: without keys
            own = set()
        text = lambda x: None if x is None else str(x)
        many = found["rows"] or 0  # without files nothing is counted
        nulls = lambda c: many - (found[f"{c}|n"] or 0) if f"{c}|n" in found else None
        return [(name, f.name, f.dataType.simpleString(), f.nullable, i + 1, f.name in own, many, nulls(f.name), text(found.get(f"{f.name}|low")), text(found.get(f"{f.name}|high")), None) for i, f in enumerate(schema)]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        rows = [r for part in pool.map(one, paths) for r in part]  # a row a column of the catalogue
    return spark.createDataFrame(rows, SHAPE)
