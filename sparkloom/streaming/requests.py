"""Events of requests as a queue with a deadline: ordered, timed out, cancelled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from . import buckets

#: Kinds of rows, in the order in which rows of one time count. What a request sends begins with start and ends with done
#: or cancel; an unknown kind is nothing that it sends.
KINDS = ("start", "event", "chunk", "error", "done", "cancel")
#: Fixed value: seconds after which a request is given up.
DEADLINE = 120
#: Seconds after its deadline for which an id is known to have ended; an id isn't used again sooner.
KEPT = 86_400
_REQUESTS = pa.schema({"request": pa.string(), "began": pa.int64(), "seq": pa.int64(), "ended": pa.bool_()})
_WAITING = pa.schema({"request": pa.string(), "at": pa.int64(), "rank": pa.int32(), "place": pa.int64(), "body": pa.string()})
_NONE = object()


def _queue(deadline: int, kept: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The requests of a bucket: rows wait until the watermark has passed them, then go out in order. Times in milliseconds.

    State is what waits, and how far each request that has begun is. That goes when it was kept for a while.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        known, held = buckets.load(state, _REQUESTS, _WAITING)
        rows = buckets.joined(held, (p[p["rank"] >= 0] for p in parts))
        ready, rest = rows.filter(pc.less(rows["at"], now)), rows.filter(pc.greater_equal(rows["at"], now))
        order = ready.to_pandas().sort_values(["request", "at", "rank", "place"], kind="stable").index
        out, name, began, seq, ended = [], _NONE, -1, 0, False

        def overdue(at: int) -> None:
            """The deadline, if it stands before a time."""
            nonlocal seq, ended
            if began is not None and not ended and at >= began + deadline:
                out.extend(((name, seq + 1, began + deadline, "timed_out", None), (name, seq + 2, began + deadline, "completed", None)))
                seq, ended = seq + 2, True

        for request, at, rank, place, body in zip(*buckets.values(ready.take(pa.array(order.to_numpy())))):
            if request != name:
                if name is not _NONE and began is not None:
                    known[name] = began, seq, ended
                name, (began, seq, ended) = request, known.get(request, (None, 0, False))
            overdue(at)
            kind = KINDS[rank]
            if ended or began is None and kind != "start":
                continue
            if began is None:
                began = at
            elif kind == "cancel":
                ended = True
            elif kind != "start":
                seq += 1
                ended = kind == "done"
                out.append((request, seq, at, "completed" if ended else kind, None if ended else body))
        if name is not _NONE and began is not None:
            known[name] = began, seq, ended
        left = {}
        for name, (began, seq, ended) in known.items():
            overdue(now)
            if now <= began + deadline + kept:
                left[name] = began, seq, ended
        buckets.save(state, left, _REQUESTS, rest)
        # the next time at which a row, a deadline or an end has passed: the bucket is called once the watermark is beyond it
        due = [pc.min(rest["at"]).as_py()] if rest.num_rows else []
        due += [b + deadline + kept if e else b + deadline - 1 for b, _, e in left.values()]
        if due:
            state.setTimeoutTimestamp(min(due))
        yield pd.DataFrame(out, columns=["request", "seq", "at", "kind", "body"])

    return step


def answers(stream: DataFrame, deadline: int = DEADLINE, late: str = "10 seconds", kept: int = KEPT, count: int = buckets.BUCKETS) -> DataFrame:
    """Per request its ordered events: request, seq (from 1), time, kind, body.

    stream: request (string), time, place (long; order within a time), kind (KINDS), body. Rows may be `late` late. A
    request begins with its start; what stands before that, and starts after it, go. event, chunk and error go out as they
    are, done as completed. At the deadline a request that has not ended gives timed_out and completed. Nothing comes after
    the end, nor after a cancel, which gives no row itself. An id's state goes `kept` seconds after its deadline; it isn't
    used again sooner. Times are in milliseconds. State is kept by `count` buckets of requests.
    """
    timed = stream.select("request", F.date_trunc("millisecond", "time").alias("time"), "place", "kind", "body").withWatermark("time", late)
    # an unknown kind is rank -1 and goes in the step: a filter here would be pushed below the watermark, which its time moves
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)).cast("int") - 1
    rows = timed.select(buckets.bucket(F.col("request"), count).alias("bucket"), "time", "request", F.unix_millis("time").alias("at"), rank.alias("rank"), "place", "body")
    sent = rows.groupBy("bucket").applyInPandasWithState(_queue(deadline * 1000, kept * 1000), "request string, seq int, at long, kind string, body string", buckets.STATE, "append", "EventTimeTimeout")
    return sent.select("request", "seq", F.timestamp_millis("at").alias("time"), "kind", "body")


def answered(rows: DataFrame, deadline: int = DEADLINE) -> DataFrame:
    """The same of a table of all rows, without a stream."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = F.struct("time", "rank", "place")
    known = rows.select("request", F.date_trunc("millisecond", "time").alias("time"), "place", "kind", "body").withColumn("rank", rank).filter("rank > 0")
    first = known.filter("kind = 'start'").groupBy("request").agg(F.min(order).alias("first"))
    begun = known.join(first, "request").withColumn("due", F.col("first.time") + F.make_interval(secs=F.lit(deadline)))
    own = begun.filter((order >= F.col("first")) & (F.col("time") < F.col("due")))
    ended = own.groupBy("request").agg(F.min(F.when(F.col("kind").isin("done", "cancel"), order)).alias("end"), F.min("due").alias("due"))
    sent = own.filter("kind IN ('event', 'chunk', 'error', 'done')").join(ended.select("request", "end"), "request").filter(F.col("end").isNull() | (order <= F.col("end")))
    sent = sent.select("request", "time", "rank", "place", F.when(F.col("kind") == "done", "completed").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") != "done", F.col("body")).alias("body"))
    over = ended.filter("end IS NULL").select("request", F.col("due").alias("time"), F.explode(F.array(F.struct(F.lit(8).alias("rank"), F.lit("timed_out").alias("kind")), F.struct(F.lit(9).alias("rank"), F.lit("completed").alias("kind")))).alias("x"))
    both = sent.unionByName(over.select("request", "time", F.col("x.rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("place"), F.col("x.kind").alias("kind"), F.lit(None).cast("string").alias("body")))
    seq = F.row_number().over(Window.partitionBy("request").orderBy("time", "rank", "place"))
    return both.withColumn("seq", seq).select("request", "seq", "time", "kind", "body")
