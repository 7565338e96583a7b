"""What the operators share: tables in the shared folder, global ranks, words."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of ASCII white space, the only separators of words in these operators.
WHITE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir where it is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:  # a local session, as in tests
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that written() made, once nothing reads it any more: what came of it is written too."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/sparkloom/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions_for(n: int, each: int, least: int = 1) -> int:
    """How many partitions of about `each` items n items need."""
    return max(least, math.ceil(n / max(1, each)))


def global_rank(df: DataFrame, order: list[Column], partitions: int, rank: str = "rank") -> DataFrame:
    """df with its rows' places (from 1) in a total order, without a single sorting task.

    Ranges of the order are written down, counted, and numbered from the sum of the counts before them. Only one
    number for each range meets in one task.
    """
    chunk, before = f"_{rank}_chunk", f"_{rank}_before"
    ranged = written(df.repartitionByRange(partitions, *order).withColumn(chunk, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(chunk).agg(F.count("*").alias("_n"))
    running = Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(chunk, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias(before))
    within = F.row_number().over(Window.partitionBy(chunk).orderBy(*order))
    # as many rows as there are ranges: bounded by `partitions`
    return (ranged.withColumn(rank, within).join(F.broadcast(starts), chunk)
            .withColumn(rank, F.col(rank) + F.col(before)).drop(chunk, before))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def in_filter(filter_bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether numbers may be in a filter: two bits of each are looked up."""
    size = np.uint64(len(filter_bits) * 8 - 1)
    one, two = x & size, (x >> np.uint64(32)) & size
    get = lambda p: (filter_bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
    return (get(one) & get(two)).astype(bool)


def member_filter(df: DataFrame, column: str, bits: int = 1 << 24):
    """A filter of a long column, of `bits` bits whatever the rows, broadcast. More rows make it pass more, never less."""
    spots = df.select(F.explode(F.array(F.col(column).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(F.col(column), 32).bitwiseAND(F.lit(bits - 1)))).alias("p"))
    pages = spots.groupBy(F.shiftright("p", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in pages.collect():  # at most bits / 32768 pages of 4096 bytes
        out[row["page"] * 4096 : row["page"] * 4096 + len(row["bits"])] |= np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return df.sparkSession.sparkContext.broadcast(out)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, led by that width."""
    top = int(values.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)
