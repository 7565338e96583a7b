"""Texts that come in chunks, shown without chart annotations as they come."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from . import buckets

#: What opens an annotation, and what closes it.
OPENERS, CLOSER = ("<!-- chart_spec:", "<!-- chart_type:"), "-->"
_OPEN = "|".join(map(re.escape, OPENERS))
_WHOLE = re.compile(rf"(?:{_OPEN}).*?{re.escape(CLOSER)}", re.S)
_OPENED = re.compile(_OPEN)
#: The end of a text that may go on to be an opener, longest first.
_BEGUN = re.compile("(?:" + "|".join(re.escape(x) for x in sorted({o[:k] for o in OPENERS for k in range(1, len(o))}, key=len, reverse=True)) + r")\Z")

_TEXTS = pa.schema({"stream": pa.string(), "place": pa.int64(), "held": pa.string(), "inside": pa.bool_()})
_EARLY = pa.schema({"stream": pa.string(), "place": pa.int64(), "chunk": pa.string(), "last": pa.bool_()})
_NONE = object()


def shown(text: Column) -> Column:
    """A whole text without annotations; one that isn't closed goes on to the end."""
    return F.regexp_replace(text, rf"(?s)(?:{_OPEN}).*?(?:{CLOSER}|\z)", "")


def feed(held: str, inside: bool, chunk: str, last: bool = False) -> tuple[str, str, bool]:
    """What a chunk shows, and what is held for the next one: the text that may become an opener or, inside an annotation,
    a closer; and whether one is open. What is held is shorter than an opener, however long the annotation."""
    text = held + chunk
    if inside:
        if (end := text.find(CLOSER)) < 0:
            return "", "" if last else text[-(len(CLOSER) - 1) :], not last
        text = text[end + len(CLOSER) :]
    text = _WHOLE.sub("", text)
    if m := _OPENED.search(text):
        return text[: m.start()], "" if last else text[m.end() :][-(len(CLOSER) - 1) :], not last
    if not last and (m := _BEGUN.search(text)):
        return text[: m.start()], m[0], False
    return text, "", False


def _filter(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The texts of a bucket: chunks go on in the order of their places; those that come early wait."""
    known, early = buckets.load(state, _TEXTS, _EARLY)
    rows = buckets.joined(early, parts)
    # of a place that comes again the first counts
    frame = pd.DataFrame({"stream": rows["stream"].to_pandas(), "place": rows["place"].to_numpy(), "row": np.arange(rows.num_rows)}).sort_values(["stream", "place", "row"])
    rows = rows.take(pa.array(frame.drop_duplicates(["stream", "place"])["row"].to_numpy()))
    at, place, held, inside, out, waits = _NONE, 0, "", False, [], []
    for k, (stream, p, chunk, last) in enumerate(zip(*buckets.values(rows))):
        if stream != at:
            if at is not _NONE:
                known[at] = place, held, inside
            at, (place, held, inside), shows = stream, known.get(stream, (0, "", False)), []
            out.append((stream, place, shows))
        if p != place or place < 0:
            if p > place >= 0:  # neither shown nor ended
                waits.append(k)
            continue
        if held or inside or "<" in chunk:
            chunk, held, inside = feed(held, inside, chunk, last)
        shows.append(chunk)
        place = -1 if last else place + 1
    if at is not _NONE:
        known[at] = place, held, inside
    buckets.save(state, known, _TEXTS, rows.take(pa.array(waits, pa.int64())))
    yield pd.DataFrame([x for x in out if x[2]], columns=["stream", "place", "shows"])


def shown_chunks(chunks: DataFrame, count: int = buckets.BUCKETS) -> DataFrame:
    """stream, place, text: what each chunk of a text shows, once all before it have come.

    chunks: stream (string), place (from 0, without gaps), chunk, last (whether the text ends). A null chunk is empty; a
    place that comes again, and what comes after the end, go. Joined in order, the texts are shown() of the whole text,
    however it is cut. Of a text that has ended a mark stays. State is kept by `count` buckets of texts.
    """
    rows = chunks.select(buckets.bucket(F.col("stream"), count).alias("bucket"), "stream", F.col("place").cast("long").alias("place"), F.coalesce("chunk", F.lit("")).alias("chunk"), F.coalesce("last", F.lit(False)).alias("last"))
    # a row for each text and batch, with what its chunks show from a place on: a row of its own for each chunk costs far more
    found = rows.groupBy("bucket").applyInPandasWithState(_filter, "stream string, place long, shows array<string>", buckets.STATE, "append", "NoTimeout")
    return found.select("stream", "place", F.posexplode("shows").alias("k", "text")).select("stream", (F.col("place") + F.col("k")).alias("place"), "text")
