"""What the vector searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(table: DataFrame, vec_id: str, embedding: str, zeros: bool) -> DataFrame:
    """vec_id long, v array<double> of rows with an id and a vector of finite numbers, of the most frequent length.

    zeros: whether vectors of zeros take part.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    if not zeros:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length["n"] if length else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long lists of numbers as a matrix of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(whole), -1).astype(np.float64) if len(whole) else np.zeros((0, 0))


def best(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """Each query's k best rows of (query_id, vec_id, score), ties to smaller vec_id, with rank."""
    order = F.desc("score") if largest else F.asc("score")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
