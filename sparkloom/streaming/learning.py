"""Ticks of a worker that judges candidates: claims and findings by batch, so that a tick that breaks off is done again."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Judge = Callable[[DataFrame], DataFrame]


class LearningQueue:
    """Candidates that come as files, claims and findings, in one folder that all machines see.

    A tick takes what has come since the last as batches. A batch's claims, then its findings, are written under the batch's
    number, each in one commit that replaces what a broken tick left there; the stream's checkpoint moves on only after
    both. So no candidate is lost, and none is found twice. Claims hold until their lease runs out; a claim without a
    finding by then is reported by overdue(), for a worker that has gone and does not come again.
    """

    def __init__(self, spark: SparkSession, folder: str, shape: str, key: str = "id", lease: int = 600):
        """shape: columns of candidates as DDL. lease: seconds."""
        self.spark, self.folder, self.shape, self.key, self.lease = spark, folder.rstrip("/"), shape, key, lease

    def put(self, candidates: DataFrame) -> None:
        candidates.write.mode("append").parquet(f"{self.folder}/candidates")

    def tick(self, judge: Judge, files: int = 100, now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc)) -> int:
        """Judges what waits, `files` files a batch; returns how many batches there were.

        judge gets a batch's candidates, a key's first row only, and gives rows with the key. A key that an earlier batch has
        a finding for goes."""
        done = 0

        def step(batch: DataFrame, number: int) -> None:
            nonlocal done
            own = batch.dropDuplicates([self.key])
            before = self._read("findings")
            if before is not None:
                own = own.join(before.filter(F.col("batch") < number).select(self.key), self.key, "left_anti")
            claims = own.select(self.key, F.lit(now() + dt.timedelta(seconds=self.lease)).cast("timestamp").alias("until"))
            claims.write.mode("overwrite").parquet(f"{self.folder}/claims/batch={number}")
            # what is claimed is judged, as written
            judge(own.join(self.spark.read.parquet(f"{self.folder}/claims/batch={number}").select(self.key), self.key, "left_semi")).write.mode("overwrite").parquet(f"{self.folder}/findings/batch={number}")
            done += 1

        source = self.spark.readStream.schema(self.shape).option("maxFilesPerTrigger", files).parquet(f"{self.folder}/candidates")
        source.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return done

    def _read(self, what: str) -> DataFrame | None:
        """A table of batches, or None before the first; a batch whose commit isn't there has no rows."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        whole = [str(x.getPath()) for x in fs.globStatus(path.suffix("/batch=*")) or [] if fs.exists(x.getPath().suffix("/_SUCCESS"))]
        return self.spark.read.option("basePath", str(path)).parquet(*whole) if whole else None

    def findings(self) -> DataFrame | None:
        """Rows that judge gave, with their batch; None before the first."""
        return self._read("findings")

    def overdue(self, now: dt.datetime) -> DataFrame | None:
        """Claims (key, until, batch) whose lease has run out without a finding; None before the first claim."""
        claims, found = self._read("claims"), self._read("findings")
        if claims is None:
            return None
        late = claims.filter(F.col("until") < F.lit(now).cast("timestamp"))
        return late.join(found.select(self.key, "batch"), [self.key, "batch"], "left_anti") if found is not None else late
