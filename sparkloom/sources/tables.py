"""Tables as views, their metadata as rows, bounded samples, and sinks for results."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Declared keys; Parquet has none.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"],
        "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"]}
METADATA = T.StructType([
    T.StructField("schema", T.StringType()), T.StructField("table", T.StringType()), T.StructField("object_type", T.StringType()), T.StructField("table_comment", T.StringType()),
    T.StructField("column", T.StringType()), T.StructField("type", T.StringType()), T.StructField("comment", T.StringType()), T.StructField("nullable", T.BooleanType()),
    T.StructField("primary_key", T.BooleanType()), T.StructField("ordinal_position", T.IntegerType()),
])
#: What the reader of an unsafe kind would not get: binary and spatial values, and nested ones.
_UNSAFE = (T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: Iterable[str] = NAMES) -> None:
    """Temporary views over the tables; nothing is read but their schemas."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def metadata(spark: SparkSession, sf_dir: str, names: Iterable[str] = NAMES, schema: str = "public") -> DataFrame:
    """A row per column of the tables, from their schemas: no data is scanned."""
    rows = []
    for name in names:
        for i, f in enumerate(table(spark, sf_dir, name).schema):
            rows.append((schema, name, "table", None, f.name, f.dataType.simpleString(), None, f.nullable, f.name in KEYS.get(name, ()), i + 1))
    return spark.createDataFrame(rows, METADATA)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata rows from a JSON list; an unknown shape of a field fails at once."""
    return spark.read.schema(METADATA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def indexes(entries: DataFrame) -> DataFrame:
    """Index entries (schema, table, index, unique, primary, method, column, position, direction) to a row per index,
    its columns in order."""
    column = F.struct("position", F.col("column").alias("name"), "direction")
    grouped = entries.groupBy("schema", "table", "index", "unique", "primary", "method").agg(F.array_sort(F.collect_list(column)).alias("columns"))
    return grouped.withColumn("columns", F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["position"].alias("position"), c["direction"].alias("direction"))))


def sample(df: DataFrame, keys: list[str], rows: int = 200, columns: int = 40) -> DataFrame:
    """The first `rows` rows by key, of at most `columns` columns of plain types: a bounded look, the same each time."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, _UNSAFE)][:columns]
    order = [*keys, *(c for c in plain if c not in keys)]
    return df.orderBy(*order).limit(rows).select(*plain)


def write_csv(df: DataFrame, folder: str) -> str:
    """Writes a result as CSV in a new folder below `folder`; a result without rows gives a file with its header."""
    path = f"{folder.rstrip('/')}/query_results_{uuid.uuid4().hex}"
    df.write.option("header", True).csv(path)
    return path


def records(df: DataFrame, limit: int = 1000) -> dict:
    """At most `limit` rows as dictionaries, with the columns, which an empty result keeps too. truncated: whether there are
    more rows; row_count counts those that are given."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    return {"columns": df.columns, "rows": rows[:limit], "row_count": min(len(rows), limit), "column_count": len(df.columns), "truncated": len(rows) > limit}


def preview(df: DataFrame, chars: int = 1000) -> str:
    """CSV text of the first rows, cut at `chars`."""
    held = records(df, 50)
    lines = [",".join(held["columns"]), *(",".join("" if v is None else str(v) for v in r.values()) for r in held["rows"])]
    return "\n".join(lines)[:chars]


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def snapshot_id(report: dict, prefix: str = "wqr-") -> str:
    """An id made from a report's content: the same content, the same id."""
    return prefix + hashlib.sha256(canonical(report).encode()).hexdigest()[:32]


def write_snapshot(spark: SparkSession, report: dict, folder: str, name: str | None = None) -> str:
    """Writes a report under its content's id, or a name; one that is there already must be equal, else ValueError.

    It is written aside and then renamed, which a file system does for one of several writers only: so there is one file
    set, whole, whoever comes first. A writer that fails leaves nothing under the name, and removes what it wrote aside.
    """
    name = name or snapshot_id(report)
    root, text = folder.rstrip("/"), canonical(report)
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = lambda x: hadoop.Path(f"{root}/{x}")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    fs = at(name).getFileSystem(conf)
    aside = f"_{name}-{uuid.uuid4().hex}"
    try:
        if not fs.exists(at(name)):
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/{aside}")
            context = hadoop.FileContext.getFileContext(fs.getUri(), conf)
            try:
                context.rename(at(aside), at(name), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
            except Py4JJavaError as e:
                if "AlreadyExists" not in e.java_exception.getClass().getName() and not fs.exists(at(name)):
                    raise  # else another writer was first
    finally:
        fs.delete(at(aside), True)
    if spark.read.text(f"{root}/{name}", wholetext=True).first()[0].rstrip("\n") != text:
        raise ValueError(f"{name} exists with other content")
    return name


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.regexp_replace("path", "^.*?" + folder.strip("/").replace(".", "\\."), "")
    return files.select(relative.alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def compare_manifests(one: DataFrame, other: DataFrame) -> DataFrame:
    """Files that are missing on a side or differ."""
    a, b = one.alias("a"), other.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    state = F.when(F.col("b.path").isNull(), "missing").when(F.col("a.path").isNull(), "added").when(F.col("a.sha256") != F.col("b.sha256"), "changed")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), state.alias("state")).filter(F.col("state").isNotNull())


def samples(spark: SparkSession, path: str) -> DataFrame:
    """A row per sample of training batches in JSON files."""
    batches = spark.read.option("multiLine", True).json(path)
    return batches.select("training_batch_id", F.explode("samples").alias("s")).select("training_batch_id", "s.*")
