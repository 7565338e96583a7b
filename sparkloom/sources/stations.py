"""Station tables as a repository: readings by month, read for half-open periods."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of readings; each is written by month.
READINGS = ("hourly", "daily")
#: What a report reads of a reading, beside its indicators.
OWN = ("id", "station_id", "monitor_time", "status", "water_quality_level")


def month_of(time: Column) -> Column:
    """A time's month as a number: 202401."""
    return (F.year(time) * 100 + F.month(time)).cast("int")


def reading(code: int) -> str:
    """The column of an indicator's readings."""
    return f"m{code + 1}_value"


class StationRepository:
    """stations, hourly, daily and targets below one folder.

    Readings are partitioned by month, so a period reads its months' files only, and of these the columns of its
    indicators. Rows that are marked as deleted (del_flag other than 0) are kept and not read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, table: str, rows: DataFrame, mode: str = "append") -> None:
        """Adds rows to a table. A month's rows are put together first, by station, so it has few files however many tasks
        write; a month of many rows is split."""
        path = f"{self.folder}/{table}"
        if table in READINGS:
            rows = rows.withColumn("month", month_of(F.col("monitor_time")))
            rows.hint("rebalance", "month").sortWithinPartitions("month", "station_id", "monitor_time").write.partitionBy("month").mode(mode).parquet(path)
        elif table == "targets":
            rows.hint("rebalance", "year").write.partitionBy("year").mode(mode).parquet(path)
        else:
            rows.write.mode(mode).parquet(path)

    def replace_months(self, table: str, rows: DataFrame) -> None:
        """Writes rows in place of those months that they have rows of; other months stay."""
        own = rows.withColumn("month", month_of(F.col("monitor_time")))
        own.hint("rebalance", "month").write.option("partitionOverwriteMode", "dynamic").partitionBy("month").mode("overwrite").parquet(f"{self.folder}/{table}")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}").filter("del_flag = '0'")

    def stations(self, kinds: Iterable[str] | None = None) -> DataFrame:
        """Stations, of some types if these are given."""
        rows = self._read("stations").drop("del_flag")
        return rows.filter(F.col("station_type").isin(list(kinds))) if kinds is not None else rows

    def readings(self, table: str, start: dt.datetime, end: dt.datetime, codes: Iterable[int] = ()) -> DataFrame:
        """Readings from start until before end, with the indicators of some codes."""
        time = F.col("monitor_time")
        within = (time >= F.lit(start)) & (time < F.lit(end))
        months = F.col("month").between(month_of(F.lit(start)), month_of(F.lit(end)))  # of files; the times decide
        return self._read(table).filter(within & months).select(*OWN, *map(reading, codes))

    def readings_of(self, table: str, periods: DataFrame, codes: Iterable[int] = ()) -> DataFrame:
        """Readings of several periods (period, start, end), each from its start until before its end, with the period.

        periods is small beside readings; which months it has is found first, and only these months' files are read.
        """
        last = F.greatest("start", F.col("end") - F.expr("INTERVAL 1 MICROSECOND"))
        each = periods.withColumn("_m", F.explode(F.sequence(F.date_trunc("month", "start"), F.date_trunc("month", last), F.expr("INTERVAL 1 MONTH")))).withColumn("month", month_of(F.col("_m"))).drop("_m")
        met = self._read(table).join(each, "month").filter((F.col("monitor_time") >= F.col("start")) & (F.col("monitor_time") < F.col("end")))
        return met.select("period", *OWN, *map(reading, codes))

    def targets(self, year: int, months: Iterable[int]) -> DataFrame:
        """Targets of a year that hold for some months or the whole year (month 0): the last one written for a section and
        month counts."""
        rows = self._read("targets").filter((F.col("year") == year) & F.col("month").isin([0, *months]))
        return rows.groupBy("section_id", "year", "month").agg(F.max_by("water_quality_target_level", "id").alias("water_quality_target_level"))
