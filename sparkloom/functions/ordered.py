"""Values carried along an order, without a sorting task for a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import ensure_checkpoint


def last_before(rows: DataFrame, key: list[str], order: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """rows with `value` replaced by the last one that isn't null, of the rows of the same key up to and including it.

    Ranges of (key, order) are cut, so a key of a third of all rows is in many of them. Each range carries its values
    along by itself; its last value of a key goes on to the key's later ranges. Null keys are a key of their own.
    """
    spark = rows.sparkSession
    ensure_checkpoint(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *key, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    within = Window.partitionBy("_range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ranged.groupBy(*key, "_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    # one row for each range that a key is in
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("_range").alias("_from"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    same: Column = F.col("_range") == F.col("_from")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = ranged.withColumn("_own", F.last(value, ignorenulls=True).over(within)).join(carried, same, "left")
    return out.select(*(F.coalesce("_own", "_carried").alias(c) if c == value else c for c in rows.columns))
