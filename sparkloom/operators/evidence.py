"""Evidence on tables of a catalogue: signs of non-business tables, time columns by name, and proposals from all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import at_most
from ..registry import register
from ..sources.store import ensure_checkpoint
from ..sources.tables import table
from .scoring import _EDGES, _profiles, duplicates, groups, mirrors, obsolete, pairs, score

#: Names of times that tell when a row was written.
AUDIT_TIMES = ("create_time", "created_at", "created_time", "update_time", "updated_at", "updated_time", "modify_time", "modified_at", "modified_time", "delete_time", "deleted_at", "import_time", "ingest_time", "sync_time")
#: Words that name a time, and words that name what was observed then.
TIME_WORDS, TIME_PARTS = ("date", "time", "datetime", "timestamp", "year", "month", "day", "hour", "at", "on"), ("时间", "日期", "年月", "年份", "月份")
OBSERVED_WORDS = ("monitor", "monitoring", "sampling", "sample", "measure", "measurement", "observe", "observation", "record", "report", "stat", "collect", "collection", "data")
OBSERVED_PARTS = ("监测时间", "采样时间", "观测时间", "数据时间", "记录时间", "测量时间", "监测日期", "采样日期", "观测日期")
#: Confidence of two kinds of evidence and of one, and what tables with business words reach at most.
BOTH, ONE, COUNTERED = 0.95, 0.55, 0.75
#: Words of a taxonomy, at most: they are broadcast.
WORDS = 10_000


def name_words(name: Column) -> Column:
    """The words of a column's name, in snake or camel case."""
    split = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[^0-9a-z一-鿿]+")
    return F.array_remove(split, "")


def _words(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def time_column(name: Column) -> Column:
    """Whether a name names a time: as a word of it, not as any part."""
    return name.rlike("|".join(TIME_PARTS)) | F.arrays_overlap(name_words(name), _words(*TIME_WORDS))


def business_time_column(name: Column) -> Column:
    """Whether a name names the time of an observation, not that of a row's writing."""
    named = F.arrays_overlap(name_words(name), _words(*TIME_WORDS)) & F.arrays_overlap(name_words(name), _words(*OBSERVED_WORDS))
    return ~F.lower(name).rlike("|".join(AUDIT_TIMES)) & (name.rlike("|".join(OBSERVED_PARTS)) | named)


def non_business(tables: DataFrame, taxonomy: DataFrame, counter: list[str]) -> DataFrame:
    """table, role, confidence: the best sign that a table holds no business data; role "" and 0 without one.

    tables: table, comment, columns (array). taxonomy: place, role, cap, kind (name or column), word; a bounded table of
    rules, broadcast, of WORDS at most. Names and two columns give BOTH, one of these ONE; roles of a cap up to COUNTERED need both and reach
    their cap. Words of `counter` keep the confidence at COUNTERED. Ties go to the first role.
    """
    text = F.lower(F.concat_ws(" ", "table", F.coalesce("comment", F.lit(""))))
    t = tables.select("table", text.alias("_text"), F.transform("columns", lambda c: F.lower(c)).alias("_columns"), F.greatest(*[F.contains(text, F.lit(w)) for w in counter], F.lit(False)).alias("_counter"))
    met = F.when(F.col("kind") == "name", F.contains("_text", F.col("word"))).otherwise(F.exists("_columns", lambda c: F.contains(c, F.col("word"))))
    hits = t.join(F.broadcast(at_most(taxonomy, WORDS, "a taxonomy's words")), met).groupBy("table", "_counter", "role").agg(F.min("place").alias("place"), F.max("cap").alias("cap"), F.count_if(F.col("kind") == "name").alias("names"), F.count_if(F.col("kind") == "column").alias("columns"))
    both, some = (F.col("names") > 0) & (F.col("columns") >= 2), (F.col("names") > 0) | (F.col("columns") >= 2)
    sure = F.when(F.col("cap") <= COUNTERED, F.when(both, F.col("cap")).otherwise(0.0)).when(both, F.least(F.lit(BOTH), F.col("cap"))).when(some, ONE).otherwise(0.0)
    rated = hits.withColumn("confidence", F.when(F.col("_counter"), F.least(sure, F.lit(COUNTERED))).otherwise(sure)).filter("confidence > 0")
    best = rated.groupBy("table").agg(F.max(F.struct("confidence", -F.col("place"), "role")).alias("b"))
    return tables.select("table").join(best, "table", "left").select("table", F.coalesce("b.role", F.lit("")).alias("role"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"))


def proposals(profiles: DataFrame) -> DataFrame:
    """table, score, decision, proposed, reason, hint, root: what to do with each table, all evidence taken together.

    Each table is scored and decided by itself. In a group, active backups of other members stand by first; of the active
    ones left, those that duplicate a better scored one do too. A hint tells members whose data is older than that of
    their group; it changes nothing. Needs what score, pairs, duplicates, mirrors and obsolete need. Scores and edges are made
    once, and cut from what they came from."""
    ensure_checkpoint(profiles.sparkSession)
    scored, edges = score(profiles).checkpoint(), pairs(profiles).checkpoint()
    roots = groups(edges)
    rooted = scored.hint("merge").join(roots, "table", "left")
    grouped = rooted.filter("root IS NOT NULL")  # a group's tables meet one another only
    within = mirrors(grouped, edges, "root").select(F.col("mirror").alias("table")).distinct()
    mirrored = within.join(scored.filter("decision = 'active'").select("table").hint("merge"), "table").withColumn("_mirror", F.lit(True)).checkpoint()
    left = grouped.filter("decision = 'active'").join(mirrored.hint("merge"), "table", "left_anti")
    twice = duplicates(left, "root").select(F.col("dropped").alias("table")).distinct().withColumn("_twice", F.lit(True))
    old = obsolete(grouped).select("table").distinct().withColumn("_old", F.lit(True))
    both = rooted.join(mirrored.hint("merge"), "table", "left").join(twice.hint("merge"), "table", "left").join(old.hint("merge"), "table", "left")
    reason = F.when(F.col("_mirror"), "backup").when(F.col("_twice"), "duplicate").otherwise("")
    return both.select("table", "score", "decision", F.when(reason != "", "standby").otherwise(F.col("decision")).alias("proposed"), reason.alias("reason"), F.coalesce("_old", F.lit(False)).alias("hint"), "root")


_NAMES = ("monitor_time", "createTime", "stat_date", "candidate_id", "update_by", "采样时间", "日期", "samplingHour", "updated_at", "data_year", "date", "monitor_value")
register("T21_time_columns", lambda s, d: table(s, d, "orders").select("o_orderkey", F.get(_words(*_NAMES), (F.col("o_orderkey") % 12).cast("int")).alias("name")).select("o_orderkey", time_column(F.col("name")).alias("time"), business_time_column(F.col("name")).alias("business")),
         "SELECT o_orderkey, o_orderkey % 12 NOT IN (3, 4, 11) AS time, o_orderkey % 12 IN (0, 2, 5, 7, 9) AS business FROM orders")
_RULES = (("log", 0.95, "name", ("small", "log")), ("log", 0.95, "column", ("user", "ip")), ("media", 0.95, "name", ("widget",)), ("media", 0.95, "column", ("file", "width")), ("place", 0.75, "name", ("promo",)), ("place", 0.75, "column", ("city", "zip")))


def _taxonomy(s: SparkSession) -> DataFrame:
    rows = [(i, role, cap, kind, w) for i, (role, cap, kind, ws) in enumerate(_RULES) for w in ws]
    return s.createDataFrame(rows, "place int, role string, cap double, kind string, word string")


def _catalogue(s: SparkSession, d: str) -> DataFrame:
    sets = "array(array('id'), array('User_Name', 'client_ip'), array('file', 'width', 'user'), array('city', 'zipcode'), array('file', 'width', 'user', 'ip'))"
    return table(s, d, "part").select(F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")).alias("table"), F.when(F.col("p_size") > 9, F.col("p_type")).alias("comment"), F.expr(f"get({sets}, int(p_partkey % 5))").alias("columns"))


register("T9_non_business", lambda s, d: non_business(_catalogue(s, d), _taxonomy(s), ["bolt", "economy"]), """
WITH p AS (SELECT replace(p_name, ' ', '_') || '_' || p_partkey AS t, p_partkey % 5 AS k, lower(replace(p_name, ' ', '_') || CASE WHEN p_size > 9 THEN ' ' || p_type ELSE '' END) AS x FROM part),
f AS (SELECT t, contains(x, 'bolt') OR contains(x, 'economy') AS counter, contains(x, 'small') OR contains(x, 'log') AS l, k IN (1, 4) AS lc, contains(x, 'widget') AS m, k IN (2, 4) AS mc, contains(x, 'promo') AS p, k = 3 AS pc FROM p),
c AS (SELECT t, counter, CASE WHEN l AND lc THEN 95 WHEN l OR lc THEN 55 ELSE 0 END AS a, CASE WHEN m AND mc THEN 95 WHEN m OR mc THEN 55 ELSE 0 END AS b, CASE WHEN p AND pc THEN 75 ELSE 0 END AS e FROM f),
n AS (SELECT t, CASE WHEN counter THEN least(a, 75) ELSE a END AS a, CASE WHEN counter THEN least(b, 75) ELSE b END AS b, e FROM c)
SELECT t AS "table", CASE WHEN greatest(a, b, e) = 0 THEN '' WHEN a >= b AND a >= e THEN 'log' WHEN b >= e THEN 'media' ELSE 'place' END AS role, greatest(a, b, e) / 100 AS confidence FROM n""")
register("T20_proposals", lambda s, d: proposals(_profiles(s, d)), _EDGES.replace("WITH q AS", "WITH RECURSIVE q AS", 1) + """
, ok AS (SELECT a, b, jaccard FROM strong WHERE confidence >= 0.55), ed AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok), walk AS (SELECT a AS t, a AS r FROM ed UNION SELECT w.t, ed.b FROM walk w JOIN ed ON w.r = ed.a), roots AS (SELECT t, min(r) AS root FROM walk GROUP BY t)
, d AS (SELECT s.*, root, concat(p_brand, k % 2) AS fp, k % 9 = 1 AS bak, CASE WHEN fresh THEN DATE '2024-01-01' - p_size * 20 END AS latest, CASE WHEN skipped OR failed THEN 'pending' WHEN nb THEN 'standby' WHEN sampled = 0 AND coalesce(rows, 0) = 0 THEN 'standby'
    WHEN score >= 80 AND confidence >= 0.55 AND NOT critical THEN 'active' WHEN score >= 60 THEN 'pending' ELSE 'standby' END AS decision FROM s LEFT JOIN roots USING (t))
, near AS (SELECT a, b FROM ok WHERE jaccard >= 0.9 UNION SELECT b, a FROM ok WHERE jaccard >= 0.9)
, mir AS (SELECT x.t FROM d x JOIN d y ON x.root = y.root AND x.bak AND NOT y.bak AND x.fp = y.fp WHERE x.decision = 'active' UNION SELECT x.t FROM near JOIN d x ON a = x.t AND x.bak JOIN d y ON b = y.t AND NOT y.bak AND x.root = y.root WHERE x.decision = 'active')
, rem AS (SELECT * FROM d WHERE decision = 'active' AND root IS NOT NULL AND t NOT IN (SELECT t FROM mir) AND sampled > 0)
, dup AS (SELECT CASE WHEN x.score >= y.score THEN y.t ELSE x.t END AS t FROM rem x JOIN rem y ON x.fp = y.fp AND x.root = y.root AND x.t < y.t WHERE abs(x.rows - y.rows) <= 0.1::DOUBLE * greatest(x.rows, y.rows))
, old AS (SELECT t FROM (SELECT t, latest, max(latest) OVER (PARTITION BY root) AS newest FROM d WHERE root IS NOT NULL) WHERE newest - latest > 365)
SELECT t AS "table", score, decision, CASE WHEN t IN (SELECT t FROM mir) OR t IN (SELECT t FROM dup) THEN 'standby' ELSE decision END AS proposed,
  CASE WHEN t IN (SELECT t FROM mir) THEN 'backup' WHEN t IN (SELECT t FROM dup) THEN 'duplicate' ELSE '' END AS reason, t IN (SELECT t FROM old) AS hint, root FROM d""")
