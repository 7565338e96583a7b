"""Queries that run tables through streams: each is dealt out as files in order, and read batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import register
from ..sources.store import shared_folder
from ..sources.tables import table
from ..streaming import buckets, requests, texts

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def through_stream(parts: list[DataFrame], run: Callable[[DataFrame], DataFrame], folder: str | None = None, stop_after: int | None = None) -> DataFrame:
    """What a stream makes of tables that come one after the other, a micro-batch each; all files are in the shared folder.

    With a folder of an earlier call the stream goes on from its checkpoint; without one a new folder is taken.
    """
    spark = parts[0].sparkSession.newSession()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # each partition has a state store to open and commit in every batch, and a task holds one bucket at a time: no more than there are cores
    partitions = int(parts[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", min(partitions, spark.sparkContext.defaultParallelism))
    spark.conf.set("spark.sql.session.timeZone", parts[0].sparkSession.conf.get("spark.sql.session.timeZone"))
    folder = folder or f"{shared_folder(parts[0].sparkSession)}/sparkloom-streams/{uuid.uuid4().hex}"
    for part in parts[:stop_after]:
        # one table a batch: its files are there before the stream looks
        part.write.mode("append").parquet(f"{folder}/in")
        stream = run(spark.readStream.schema(part.schema).parquet(f"{folder}/in"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return parts[0].sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _requests(s: SparkSession, d: str) -> list[DataFrame]:
    """A request for each user and day: its first event starts it, and its others follow within minutes, by the second of
    their own time. Two slices of ids, then the time that ends all."""
    e = table(s, d, "events")
    day = F.unix_date(F.col("ts").cast("date"))
    ends = F.element_at(F.array(*map(F.lit, ("event", "chunk", "chunk", "error", "chunk", "event", "done", "cancel", "other", "chunk", "start"))), (F.col("event_id") % 11 + 1).cast("int"))
    rows = e.withColumns({"request": F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), day.cast("string")), "n": day.cast("long")})
    first = rows.groupBy("request").agg(F.min("event_id").alias("first"))
    rows = rows.join(first, "request").select(
        "request", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") % 3 + F.when(F.col("event_id") == F.col("first"), 0).otherwise(1 + F.col("event_id") % 160)).alias("time"), F.col("event_id").alias("place"),
        F.when(F.col("event_id") == F.col("first"), F.lit("start")).otherwise(ends).alias("kind"), F.col("event_type").alias("body"))
    tick = s.range(1).select(F.lit("tick").alias("request"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("time"), F.lit(0).cast("long").alias("place"), F.lit("tick").alias("kind"), F.lit(None).cast("string").alias("body"))
    early = F.col("time") < F.timestamp_seconds(F.lit(1_700_000_060))
    return [rows.filter(early), rows.filter(~early), tick]


register("Z1_request_events", lambda s, d: through_stream(_requests(s, d), lambda x, n=buckets.number(table(s, d, "events").count()): requests.answers(x, count=n)).select("request", "seq", F.unix_timestamp("time").alias("second"), "kind", "body"), """
WITH e AS (SELECT *, 'u' || user_id || '-' || date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS request, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS n FROM events),
r AS (SELECT *, min(event_id) OVER (PARTITION BY request) AS f FROM e),
k AS (
  SELECT request, 1700000000 + n % 3 + CASE WHEN event_id = f THEN 0 ELSE 1 + event_id % 160 END AS t, event_id AS place, event_type AS body,
    CASE WHEN event_id = f THEN 'start' ELSE ['event', 'chunk', 'chunk', 'error', 'chunk', 'event', 'done', 'cancel', 'other', 'chunk', 'start'][event_id % 11 + 1] END AS kind FROM r
), o AS (SELECT *, list_position(['start', 'event', 'chunk', 'error', 'done', 'cancel'], kind) AS rank FROM k WHERE kind <> 'other'),
b AS (SELECT *, min(t) FILTER (WHERE kind = 'start') OVER (PARTITION BY request) AS began FROM o),
w AS (SELECT *, min(CASE WHEN kind IN ('done', 'cancel') THEN {'t': t, 'r': rank, 'p': place} END) OVER (PARTITION BY request) AS ending FROM b WHERE t < began + 120),
s AS (
  SELECT request, t, rank, place, CASE WHEN kind = 'done' THEN 'completed' ELSE kind END AS kind, CASE WHEN kind <> 'done' THEN body END AS body
  FROM w WHERE kind IN ('event', 'chunk', 'error', 'done') AND (ending IS NULL OR {'t': t, 'r': rank, 'p': place} <= ending)
  UNION ALL SELECT DISTINCT request, began + 120, 8, 0, 'timed_out', NULL FROM w WHERE ending IS NULL
  UNION ALL SELECT DISTINCT request, began + 120, 9, 0, 'completed', NULL FROM w WHERE ending IS NULL
)
SELECT request, CAST(row_number() OVER (PARTITION BY request ORDER BY t, rank, place) AS INTEGER) AS seq, CAST(t AS BIGINT) AS second, kind, body FROM s""")


def _annotated(text: str, k: str) -> str:
    """SQL of both engines: a text with an annotation within, or an open one, or a comment of another kind at its end."""
    return f"""CASE {k} % 4 WHEN 0 THEN concat(substr({text}, 1, 20), '<!-- chart_spec: {{"type":"bar"}} -->', substr({text}, 21)) WHEN 1 THEN concat({text}, '<!-- chart_type: pie')
    WHEN 2 THEN concat({text}, '<!-- note --><!-- chart_spe') ELSE {text} END"""


def _chunks(s: SparkSession, d: str) -> list[DataFrame]:
    """Each turn of a conversation cut into chunks of 7 characters; every other chunk comes first."""
    c = table(s, d, "conversations").filter("text IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    c = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream"), F.expr(_annotated("text", "(conv_id + turn)")).alias("text"))
    # one pass over a text, where a substring for each place would begin at its start again
    pieces = F.when(F.length("text") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0)))
    cut = c.select("stream", pieces.alias("pieces")).select("stream", F.size("pieces").alias("n"), F.posexplode("pieces").alias("place", "chunk"))
    rows = cut.select("stream", F.col("place").cast("long").alias("place"), "chunk", (F.col("place") == F.col("n") - 1).alias("last"))
    return [rows.filter("place % 2 = 0"), rows.filter("place % 2 = 1")]


def _text_buckets(s: SparkSession, d: str) -> int:
    """By the chunks of all texts, an annotation apart."""
    return buckets.number(table(s, d, "conversations").agg(F.sum(F.length("text") / 7 + 1)).first()[0] or 0)


register("Z2_shown_texts", lambda s, d: through_stream(_chunks(s, d), lambda x, n=_text_buckets(s, d): texts.shown_chunks(x, n)).groupBy("stream").agg(
    F.count("*").alias("chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "").alias("text")), f"""
WITH c AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2),
a AS (SELECT concat(conv_id, '-', turn) AS stream, {_annotated("text", "(conv_id + turn)")} AS text FROM c)
SELECT stream, CAST(greatest(1, ceil(length(text) / 7)) AS BIGINT) AS chunks, regexp_replace(text, '(?:<!-- chart_spec:|<!-- chart_type:)(?:.|\\n)*?(?:-->|\\z)', '', 'g') AS text FROM a""")
