"""Jobs within a time of their own and one for all: a slow or failing one is marked and the others go on."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from threading import Timer
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Outcome:
    """state: done, failed, timed_out or skipped (the time for all was used up)."""

    state: str
    value: Any = None
    error: str = ""


def within(spark: SparkSession, jobs: dict[str, Callable[[], Any]], each: float = 30.0, total: float = 600.0) -> dict[str, Outcome]:
    """Runs jobs one after the other. A job that takes longer than `each` seconds has its Spark tasks cancelled; when
    `total` is used up the rest are skipped."""
    end, out = time.monotonic() + total, {}
    for name, job in jobs.items():
        left = min(each, end - time.monotonic())
        if left <= 0:
            out[name] = Outcome("skipped")
            continue
        group, context = f"budget-{uuid.uuid4().hex}", spark.sparkContext
        context.setJobGroup(group, name, interruptOnCancel=True)
        late: list[bool] = []
        timer = Timer(left, lambda: (late.append(True), context.cancelJobGroup(group)))
        timer.start()
        try:
            out[name] = Outcome("done", job())
        except Exception as e:  # a cancelled or failing job is told, not raised: profiles go on
            if not late and not isinstance(e, (PySparkException, ValueError)):
                raise
            out[name] = Outcome("timed_out" if late else "failed", error=str(e).splitlines()[0][:200] if str(e) else type(e).__name__)
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
    return out
