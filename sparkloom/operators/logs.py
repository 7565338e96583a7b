"""Logs of conversations: events of a stream, frames of data, chart annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import last_before
from ..registry import register
from ..sources.tables import table

#: Charts of one message at most, and the types that can be drawn.
MOST_CHARTS = 4
TYPES = ("bar", "horizontal_bar", "line", "area", "pie", "donut", "scatter", "bubble", "radar", "heatmap", "boxplot", "gauge", "combo")
_SPEC = r"(?is)<!--\s*chart_spec:\s*(.*?)\s*-->"
_SHAPE = "type string, title string, xField string, yFields array<string>, seriesField string, sizeField string, valueField string, min double, max double, unit string"


def stream_events(lines: DataFrame) -> DataFrame:
    """lines (with a text column `line`) that hold an event of JSON, with type, message and body (the event as text).

    Only `data:` lines count; the end mark and what is no JSON object go."""
    body = F.trim(F.regexp_extract("line", r"^data:(.*)$", 1))
    event = F.from_json(body, "type string, message_id string")
    return lines.filter(F.startswith("line", F.lit("data:"))).withColumns({"body": body, "_e": event}).filter(F.col("body").rlike(r"(?s)^\{.*\}$") & F.col("_e.type").isNotNull()).select(*[c for c in lines.columns if c != "line"], F.col("_e.type").alias("type"), F.col("_e.message_id").alias("message"), "body")


def frames(events: DataFrame) -> DataFrame:
    """Events of type dataframe with columns (array of names) and rows (array of maps of text)."""
    held = F.from_json("body", "columns array<string>, rows array<map<string,string>>")
    return events.filter("type = 'dataframe'").withColumn("_f", held).select(*[c for c in events.columns if c != "body"], F.coalesce("_f.columns", F.array().cast("array<string>")).alias("columns"), F.coalesce("_f.rows", F.array().cast("array<map<string,string>>")).alias("rows"))


def slim(charts: DataFrame) -> DataFrame:
    """charts as they are stored: without their source rows, which are counted."""
    return charts.withColumn("source_rows", F.size(F.coalesce("rows", F.array().cast("array<map<string,string>>")))).drop("rows")


def rehydrate(charts: DataFrame, data: DataFrame) -> DataFrame:
    """Stored charts (message, place) with the rows of the last frame of their message, before or at their place, that isn't
    empty; null if there is none. data: message, place, rows.

    An as-of join: frames and charts are one order by message and place, along which the last frame's place is carried;
    no chart meets more than one frame."""
    frames = data.filter((F.size("rows") > 0) & F.col("message").isNotNull()).groupBy("message", "place").agg(F.min_by("rows", F.to_json("rows")).alias("rows"))
    marks = frames.select("message", "place", F.lit(0).alias("_kind"), F.col("place").alias("_frame"))
    asked = charts.select("message", "place").distinct().select("message", "place", F.lit(1).alias("_kind"), F.lit(None).cast(frames.schema["place"].dataType).alias("_frame"))
    found = last_before(marks.unionByName(asked), ["message"], ["place", "_kind"], "_frame").filter("_kind = 1").drop("_kind")
    held = found.join(frames.select("message", F.col("place").alias("_frame"), "rows"), ["message", "_frame"], "left").select(F.col("message").alias("_message"), F.col("place").alias("_place"), "rows")
    return charts.join(held, charts["message"].eqNullSafe(F.col("_message")) & charts["place"].eqNullSafe(F.col("_place")), "left").drop("_message", "_place")


def visible_text(text: Column) -> Column:
    """A text without chart annotations, an open one at its end too."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _SPEC, ""), r"(?i)<!--\s*chart_type:\s*(bar|line|pie|none)\s*-->", ""), r"(?s)<!--.*$", ""))


def chart_specs(text: Column, columns: Column) -> Column:
    """The charts that a text asks for, as an array of type, x, ys, error: the first MOST_CHARTS that aren't none.

    error: the type can't be drawn, or fields that aren't among the columns, else null. What is no JSON is left out."""
    parsed = F.transform(F.regexp_extract_all(text, F.lit(_SPEC), F.lit(1)), lambda x: F.when(x.rlike(r"(?s)^\{.*\}$"), F.from_json(x, _SHAPE)))
    wanted = F.slice(F.filter(parsed, lambda p: p.isNotNull() & p["type"].isNotNull() & (F.lower(p["type"]) != "none")), 1, MOST_CHARTS)

    def one(p: Column) -> Column:
        kind, ys = F.lower(p["type"]), F.coalesce(F.array_compact(p["yFields"]), F.array().cast("array<string>"))
        named = F.array_compact(F.concat(F.array(p["xField"]), ys, F.array(p["seriesField"], p["sizeField"], p["valueField"])))
        unknown = F.array_except(F.filter(named, lambda n: n != ""), columns)
        error = F.when(~kind.isin(*TYPES), F.concat(F.lit("type: "), kind)).when(F.size(unknown) > 0, F.concat(F.lit("fields: "), F.array_join(unknown, ", ")))
        return F.struct(kind.alias("type"), p["xField"].alias("x"), ys.alias("ys"), error.alias("error"))

    return F.transform(wanted, one)


def _lines(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = F.when(k % 3 == 0, "[]").otherwise(F.concat(F.lit('[{"a":"'), k.cast("string"), F.lit('"}]')))
    line = (F.when(k % 5 == 0, F.concat(F.lit('data: {"type":"dataframe","message_id":"m'), (k % 40).cast("string"), F.lit('","columns":["a"],"rows":'), rows, F.lit("}"))).when(k % 5 == 1, F.concat(F.lit('data:{"type":"text","message_id":"m'), (k % 40).cast("string"), F.lit('"}')))
            .when(k % 5 == 2, "data: [DONE]").when(k % 5 == 3, "event: ping").otherwise("data: {broken"))
    return table(s, d, "events").select(k.alias("place"), line.alias("line"))


register("L15_stream_events", lambda s, d: stream_events(_lines(s, d)).select("place", "type", "message"), "SELECT event_id AS place, CASE event_id % 5 WHEN 0 THEN 'dataframe' ELSE 'text' END AS type, 'm' || event_id % 40 AS message FROM events WHERE event_id % 5 <= 1")
register("L15_frames", lambda s, d: frames(stream_events(_lines(s, d))).select("place", "message", F.array_join("columns", ",").alias("columns"), F.size("rows").alias("n"), F.try_element_at(F.get("rows", F.lit(0)), F.lit("a")).alias("a")),
         "SELECT event_id AS place, 'm' || event_id % 40 AS message, 'a' AS columns, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN event_id % 3 > 0 THEN event_id::VARCHAR END AS a FROM events WHERE event_id % 5 = 0")
_charts = lambda s, d: table(s, d, "events").filter("event_id % 10 = 5").select(F.concat(F.lit("m"), (F.col("event_id") % 40).cast("string")).alias("message"), F.col("event_id").alias("place"), F.array(F.create_map(F.lit("a"), F.lit("x"))).alias("rows"))
_frames = lambda s, d: frames(stream_events(_lines(s, d))).select("message", "place", "rows")
register("L14_rehydrated", lambda s, d: rehydrate(slim(_charts(s, d)), _frames(s, d)).select("message", "place", "source_rows", F.try_element_at(F.get("rows", F.lit(0)), F.lit("a")).alias("a")), """
WITH f AS (SELECT event_id AS k FROM events WHERE event_id % 5 = 0 AND event_id % 3 > 0), c AS (SELECT event_id AS p FROM events WHERE event_id % 10 = 5)
SELECT 'm' || p % 40 AS message, p AS place, 1 AS source_rows, CAST(max(k) AS VARCHAR) AS a FROM c LEFT JOIN f ON k % 40 = p % 40 AND k <= p GROUP BY p""")
_SAID = (
    'Here. <!-- chart_spec: {"type":"Bar","xField":"a","yFields":["b"]} -->', '<!--chart_spec: {"type":"pie","xField":"z","yFields":["b", "y"]}--> and <!-- chart_spec: {"type":"none"} -->', "none <!-- chart_spec: {broken -->", 'open <!-- chart_spec: {"type"', '<!-- chart_type: bar -->  x <!-- chart_spec: {"type":"star"} -->',
)
register("H9_chart_specs", lambda s, d: table(s, d, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, _SAID)), (F.col("o_orderkey") % 5).cast("int")).alias("t")).select("o_orderkey", visible_text(F.col("t")).alias("text"), F.array_join(F.transform(chart_specs(F.col("t"), F.array(F.lit("a"), F.lit("b"))), lambda c: F.concat_ws("/", c["type"], c["x"], F.array_join(c["ys"], ","), c["error"])), "|").alias("charts")), """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Here.' WHEN 1 THEN ' and' WHEN 2 THEN 'none' WHEN 3 THEN 'open' ELSE '  x' END AS text,
  CASE o_orderkey % 5 WHEN 0 THEN 'bar/a/b' WHEN 1 THEN 'pie/z/b,y/fields: z, y' WHEN 4 THEN 'star//type: star' ELSE '' END AS charts FROM orders""")
