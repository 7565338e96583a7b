"""Episodes over a stream: an extension, as monitoring reports themselves are batch jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Readings by station and hour, for rows that are at most `late` late: count, mean, largest."""
    return (stream.withWatermark("time", late).groupBy("station_id", F.window("time", "1 hour"))
            .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
            .select("station_id", F.col("window.start").alias("hour"), "n", "mean", "most"))


def episode_starts(stream: DataFrame, run: int) -> DataFrame:
    """station_id, day: the days on which a run of matched days reaches `run`. Needs: station_id, day (date), matched.

    State per station is the last day and the length of its run; days must come in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, length = state.get if state.exists else (None, 0)
        found = []
        for day, matched in sorted((d, bool(m)) for b in batches for d, m in zip(b["day"], b["matched"])):
            n = day.toordinal()
            if last is not None and n <= last:
                continue
            length = (length + 1 if last is not None and n == last + 1 else 1) if matched else 0
            last = n
            if length == run:
                found.append((key[0], day))
        state.update((last, length))
        yield pd.DataFrame(found, columns=["station_id", "day"])

    return stream.groupBy("station_id").applyInPandasWithState(step, "station_id long, day date", "last long, length long", "append", GroupStateTimeout.NoTimeout)
