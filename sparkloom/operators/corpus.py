"""Corpora of examples, learned candidates, memories, ranked search and question rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import at_most
from ..registry import register
from ..sources.store import shared_folder
from ..sources.tables import table
from ..sources.vectors import VectorStore

#: Terms that texts are searched for, at most: they are broadcast.
TERMS = 100_000
#: States of a candidate and those that may follow.
STATES = {
    "staged": ("judging", "needs_review", "reject", "pass"), "judging": ("pass", "needs_review", "reject", "staged"), "pass": ("publish_pending", "superseded"),
    "needs_review": ("publish_pending", "reject", "superseded", "pass"), "reject": ("superseded",), "publish_pending": ("publishing", "needs_review", "reject", "publish_failed", "superseded"),
    "publishing": ("published", "publish_failed"), "published": ("superseded",), "publish_failed": ("publish_pending", "publishing", "needs_review", "reject", "superseded"), "superseded": (),
}
#: Names of fields that are never told, and what stands for them and in texts.
SECRET_FIELDS = ("api_key", "apikey", "authorization", "cookie", "db_password", "database_password", "password", "connection_string", "database_url")
SECRET_TEXTS = ((r"(?i)(authorization\s*[:=]\s*bearer\s+)\S+", "$1[REDACTED]"), (r"(?i)\bsk-[A-Za-z0-9_-]{8,}\b", "[REDACTED]"), (r"(?i)postgres(?:ql)?://[^\s'\"}]+", "[REDACTED_CONNECTION_STRING]"))


def normal_question(text: Column) -> Column:
    """A question without blanks and marks at its end."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "[?？。.!！,，;；]+$", "")


def normal_sql(text: Column) -> Column:
    """SQL without comments, in lower case, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def record_id(source: Column, kind: Column, document: Column) -> Column:
    return F.concat(F.lit("b5-"), F.sha2(F.concat_ws("|", source, kind, document), 256))


def redact(text: Column) -> Column:
    """A text without bearer tokens, keys that begin with sk- and connection strings of PostgreSQL."""
    for pattern, by in SECRET_TEXTS:
        text = F.regexp_replace(text, pattern, by)
    return text


def _redacted(value: Column, kind: T.DataType, name: str = "") -> Column:
    if name.lower() in SECRET_FIELDS:
        return F.lit("[REDACTED]")
    if isinstance(kind, T.StringType):
        return redact(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_redacted(value[f.name], f.dataType, f.name).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _redacted(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        return F.transform_values(value, lambda k, v: F.when(F.lower(k).isin(*SECRET_FIELDS), "[REDACTED]").otherwise(redact(v)))
    return value


def redacted(df: DataFrame) -> DataFrame:
    """df without secrets: fields of SECRET_FIELDS at any depth become a mark, all texts are redacted."""
    return df.select(*[_redacted(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema])


def write_plan(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """What becomes of each record (id, batch, body): create, resume (same batch), other_batch, or conflict."""
    b, s = batch.alias("b"), stored.alias("s")
    action = F.when(F.col("s.id").isNull(), "create").when(F.col("s.body") != F.col("b.body"), "conflict").when(F.col("s.batch") == F.col("b.batch"), "resume").otherwise("other_batch")
    return b.join(s, F.col("b.id") == F.col("s.id"), "left").select(F.col("b.id").alias("id"), action.alias("action"))


def memory_plan(new: DataFrame, old: DataFrame) -> DataFrame:
    """id and action: create, unchanged, changed or removed, by id and body."""
    n, o = new.alias("n"), old.alias("o")
    action = F.when(F.col("o.id").isNull(), "create").when(F.col("n.id").isNull(), "removed").when(F.col("n.body") == F.col("o.body"), "unchanged").otherwise("changed")
    return n.join(o, F.col("n.id") == F.col("o.id"), "full").select(F.coalesce("n.id", "o.id").alias("id"), action.alias("action"))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, min, max, sum, avg to six digits."""
    wide = df.agg(*[F.struct(F.lit(c).alias("column"), F.round(F.min(c), 6).alias("min"), F.round(F.max(c), 6).alias("max"), F.round(F.sum(c), 6).alias("sum"), F.round(F.avg(c), 6).alias("avg")).alias(f"_{i}") for i, c in enumerate(columns)])
    return wide.select(F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))


def allowed_moves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, after in STATES.items() for b in after], "before string, after string")


def bad_moves(moves: DataFrame) -> DataFrame:
    """Moves (id, before, after) that the states don't allow."""
    return moves.join(F.broadcast(allowed_moves(moves.sparkSession)), ["before", "after"], "left_anti")


def judged(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """rows with status, what a judge's finding makes of a candidate: pass only if it says PASS with enough confidence, all is
    aligned and valid, and nothing is ambiguous or at risk; reject if it says REJECT; else needs_review.

    Needs: verdict, confidence, question_sql_aligned, answer_result_aligned, metadata_valid, business_ambiguity, risk_flags (array)."""
    c = F.col
    ok = (c("verdict") == "PASS") & (c("confidence") >= least) & c("question_sql_aligned") & c("answer_result_aligned") & c("metadata_valid") & ~c("business_ambiguity") & (F.size(F.coalesce("risk_flags", F.array().cast("array<string>"))) == 0)
    return rows.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "pass").when(c("verdict") == "REJECT", "reject").otherwise("needs_review"))


def ready_batches(candidates: DataFrame, now: Column, size: int, wait_days: int) -> DataFrame:
    """Sources whose candidates are enough, or have waited long enough."""
    got = candidates.groupBy("source").agg(F.count("*").alias("n"), F.min("at").alias("oldest"))
    return got.withColumn("ready", (F.col("n") >= size) | (F.col("oldest") <= now - F.make_interval(days=F.lit(wait_days))))


def publication(candidates: DataFrame, published: DataFrame) -> DataFrame:
    """id and state: superseded if its fingerprint is published or held by a smaller id, review if its question is
    published with other SQL, else publish. Needs: id, question, sql."""
    c = candidates.withColumns({"fp": fingerprint(normal_question(F.col("question")), normal_sql(F.col("sql"))), "q": normal_question(F.col("question"))})
    p = published.select(fingerprint(normal_question(F.col("question")), normal_sql(F.col("sql"))).alias("fp"), normal_question(F.col("question")).alias("q"))
    first = c.groupBy("fp").agg(F.min("id").alias("first"))
    known, asked = p.select("fp", F.lit(True).alias("known")).distinct(), p.select("q", F.lit(True).alias("asked")).distinct()
    both = c.join(first, "fp").join(known, "fp", "left").join(asked, "q", "left")
    return both.select("id", F.when(F.col("known") | (F.col("id") != F.col("first")), "superseded").when(F.col("asked"), "review").otherwise("publish").alias("state"))


def similar(memories: DataFrame, query: list[float], k: int, least: float = 0.55, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k memories most like a query by cosine, at `least` or above."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.transform(F.col(vector), lambda x: x.cast("double")), q, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    norm = F.sqrt(F.aggregate(F.transform(F.col(vector), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b))
    length = sum(x * x for x in query) ** 0.5
    return memories.select(key, (F.try_divide(dot, norm * length)).alias("cosine")).filter(F.col("cosine") >= least).orderBy(F.desc("cosine"), key).limit(k)


def repair_keys(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (schema, table, fields) with a blank schema folded into the one of that table that has a schema: the first value
    that isn't blank counts, the named schema's before."""
    named = rows.filter("coalesce(schema, '') <> ''").groupBy("schema", "table").agg(*[F.max(F.nullif(f, F.lit(""))).alias(f) for f in fields])
    blank = rows.filter("coalesce(schema, '') = ''").groupBy("table").agg(*[F.max(F.nullif(f, F.lit(""))).alias(f"_{f}") for f in fields])
    return named.join(blank, "table", "left").select("schema", "table", *[F.coalesce(f, f"_{f}").alias(f) for f in fields])


def reconcile(draft: DataFrame, review: DataFrame, fields: list[str]) -> DataFrame:
    """Ids on one side only, or with fields that differ (nulls are equal)."""
    d, r = draft.alias("d"), review.alias("r")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"d.{f}").eqNullSafe(F.col(f"r.{f}"))
    state = F.when(F.col("r.id").isNull(), "draft only").when(F.col("d.id").isNull(), "review only").when(~same, "differs")
    return d.join(r, F.col("d.id") == F.col("r.id"), "full").select(F.coalesce("d.id", "r.id").alias("id"), state.alias("state")).filter(F.col("state").isNotNull())


def compact(text: Column) -> Column:
    """Lower case without blanks and marks."""
    return F.regexp_replace(F.lower(text), r"[\s\p{Punct}，。？！、；：“”（）]+", "")


def ratio(a: Column, b: Column) -> Column:
    """Likeness of two texts by matching blocks, 0 to 1. Batches of rows go through Python's matcher: Spark has none."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def match(x, y):
        from difflib import SequenceMatcher

        import pandas as pd

        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)])

    return match(a, b)


def rank_columns(metadata: DataFrame, question: str, top: int = 10) -> DataFrame:
    """The best columns for a question: an exact name, a name in it, then a comment, then likeness from .72."""
    q, name, comment = compact(F.lit(question)), compact(F.col("column")), compact(F.coalesce("comment", F.lit("")))
    inside = lambda x: (x != "") & F.contains(q, x)
    like = ratio(name, q)
    points = F.when(name == q, 1000).when(inside(name), 520).when(comment == q, 900).when(inside(comment), 650).when(like >= 0.72, F.floor(520 * like).cast("int")).otherwise(0)
    return metadata.select("table", "column", points.cast("int").alias("score")).filter("score > 0").orderBy(F.desc("score"), F.length("column"), "table", "column").limit(top)


def families(tables: DataFrame) -> DataFrame:
    """table and family: the first two words of its name without version and grain; alone, a table has none."""
    base = F.regexp_replace(F.regexp_replace("table", r"_v\d+$", ""), "_(hour|day|month|year)$", "")
    family = F.array_join(F.slice(F.split(base, "_"), 1, 2), "_")
    rows = tables.withColumn("_f", family)
    return rows.select("table", F.when(F.count("*").over(Window.partitionBy("_f")) > 1, F.col("_f")).otherwise("").alias("family"))


def suggest(scores: DataFrame, current: str) -> DataFrame:
    """The source to switch to: the current one has at most 4 points, the best at least 6, and leads by 3. Needs: source, points."""
    ranked = scores.filter(F.col("source") != current).withColumns({"k": F.row_number().over(Window.orderBy(F.desc("points"), "source")), "next": F.lead("points").over(Window.orderBy(F.desc("points"), "source"))})
    own = scores.filter(F.col("source") == current).agg(F.coalesce(F.max("points"), F.lit(0)).alias("own"))
    return ranked.filter("k = 1").join(F.broadcast(own)).select("source", ((F.col("own") <= 4) & (F.col("points") >= 6) & (F.col("points") - F.coalesce("next", F.lit(0)) >= 3)).alias("suggested"))


def source_points(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Points of each source for each text: 5 for a text that names it, and 4 and 2 for each hit, 6 at most, of its aliases.

    terms: source, kind (name or alias), term: a bounded table of rules, so it is broadcast."""
    hits = texts.join(F.broadcast(at_most(terms, TERMS, "terms")), F.contains(F.lower("text"), F.col("term")))
    got = hits.groupBy("id", "source").agg(F.count_if(F.col("kind") == "name").alias("names"), F.count_if(F.col("kind") == "alias").alias("aliases"))
    return got.select("id", "source", (5 * F.col("names") + F.when(F.col("aliases") > 0, 4 + F.least(F.lit(6), 2 * F.col("aliases"))).otherwise(0)).cast("long").alias("points"))


def date_literals(sql: Column) -> Column:
    """The dates of comparisons in a text."""
    return F.regexp_extract_all(sql, F.lit(r"(?:<|>|=)\s*'(\d{4}-\d{2}-\d{2})"), F.lit(1))


def window_of(latest: Column, days: int) -> tuple[Column, Column]:
    """The half-open range of the last `days` days up to and with `latest`."""
    return F.date_sub(latest, days - 1), F.date_add(latest, 1)


def month_of(latest: Column) -> tuple[Column, Column]:
    """The half-open range of latest's month."""
    return F.trunc(latest, "month"), F.trunc(F.add_months(latest, 1), "month")


def seeded(pool: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    """k rows of a pool by the hashes of their keys and a seed: the same each time."""
    return pool.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256), key).limit(k)


# --- bindings
_c = lambda s, d: table(s, d, "conversations")
register("L1_normal_question", lambda s, d: _c(s, d).select("conv_id", "turn", normal_question(F.col("text")).alias("q")),
         r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\s+', '', 'g'), '[?？。.!！,，;；]+$', '') AS q FROM conversations")
register("L2_normal_sql", lambda s, d: table(s, d, "part").select("p_partkey", normal_sql(F.concat(F.lit("SELECT  a -- note\n FROM /* x\ny */ T WHERE n = '"), F.col("p_name"), F.lit("'  "))).alias("sql")), "SELECT p_partkey, concat('select a from t where n = ''', lower(p_name), '''') AS sql FROM part")
register("L3_fingerprint", lambda s, d: table(s, d, "part").select("p_partkey", fingerprint(F.col("p_brand"), F.col("p_name"), F.col("p_type")).alias("fp")), "SELECT p_partkey, sha256(concat(p_brand, chr(10), p_name, chr(10), p_type)) AS fp FROM part")
register("L6_numeric_summary", lambda s, d: numeric_summary(table(s, d, "part"), ["p_size", "p_retailprice"]).select("column", F.round("min", 2).alias("min"), F.round("max", 2).alias("max"), F.round("sum", 2).alias("sum"), F.round("avg", 4).alias("avg")),
         "SELECT 'p_size' AS \"column\", round(min(p_size), 2)::DOUBLE AS min, round(max(p_size), 2)::DOUBLE AS max, round(sum(p_size), 2)::DOUBLE AS sum, round(avg(p_size), 4) AS avg FROM part UNION ALL SELECT 'p_retailprice', round(min(p_retailprice), 2), round(max(p_retailprice), 2), round(sum(p_retailprice), 2), round(avg(p_retailprice), 4) FROM part")
_ALL = sorted({*STATES, *(x for v in STATES.values() for x in v)})


def _moves(s, d):
    names, k = F.array(*[F.lit(x) for x in _ALL]), F.col("event_id")
    return table(s, d, "events").select(k.alias("id"), F.element_at(names, (k % len(_ALL) + 1).cast("int")).alias("before"), F.element_at(names, (F.floor(k / 7) % len(_ALL) + 1).cast("int")).alias("after"))


register("L7_bad_moves", lambda s, d: bad_moves(_moves(s, d)).groupBy("before").agg(F.count("*").alias("n")), """
WITH m AS (SELECT n[event_id % 10 + 1] AS before, n[event_id // 7 % 10 + 1] AS after FROM events, (SELECT ['judging', 'needs_review', 'pass', 'publish_failed', 'publish_pending', 'published', 'publishing', 'reject', 'staged', 'superseded'] AS n))
SELECT before, count(*) AS n FROM m WHERE NOT CASE before WHEN 'staged' THEN after IN ('judging', 'needs_review', 'reject', 'pass') WHEN 'judging' THEN after IN ('pass', 'needs_review', 'reject', 'staged') WHEN 'pass' THEN after IN ('publish_pending', 'superseded')
  WHEN 'needs_review' THEN after IN ('publish_pending', 'reject', 'superseded', 'pass') WHEN 'reject' THEN after = 'superseded' WHEN 'publish_pending' THEN after IN ('publishing', 'needs_review', 'reject', 'publish_failed', 'superseded')
  WHEN 'publishing' THEN after IN ('published', 'publish_failed') WHEN 'published' THEN after = 'superseded' WHEN 'publish_failed' THEN after IN ('publish_pending', 'publishing', 'needs_review', 'reject', 'superseded') ELSE false END GROUP BY 1""")
_verdicts = lambda s, d: table(s, d, "part").select(
    "p_partkey", F.get(F.array(F.lit("PASS"), F.lit("REVIEW"), F.lit("PASS"), F.lit("REJECT")), (F.col("p_partkey") % 4).cast("int")).alias("verdict"), (F.col("p_size") / 50).alias("confidence"), (F.col("p_partkey") % 5 > 0).alias("question_sql_aligned"), F.when(F.col("p_partkey") % 7 > 0, True).alias("answer_result_aligned"),
    F.lit(True).alias("metadata_valid"), (F.col("p_partkey") % 11 == 0).alias("business_ambiguity"), F.when(F.col("p_partkey") % 13 == 0, F.array(F.lit("joins"))).alias("risk_flags"))
register("L8_judge_gate", lambda s, d: judged(_verdicts(s, d), 0.5).select("p_partkey", "status"), """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size / 50 >= 0.5 AND p_partkey % 5 > 0 AND p_partkey % 7 > 0 AND p_partkey % 11 > 0 AND p_partkey % 13 > 0 THEN 'pass' WHEN p_partkey % 4 = 3 THEN 'reject' ELSE 'needs_review' END AS status FROM part""")
register("L9_page", lambda s, d: table(s, d, "orders").filter("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
register("L10_ready", lambda s, d: ready_batches(table(s, d, "events").select(F.col("user_id").alias("source"), F.col("ts").alias("at")), F.lit("2024-01-31").cast("timestamp_ntz"), 3, 14).select("source", "n", "ready"),
         "SELECT user_id AS source, count(*) AS n, count(*) >= 3 OR min(ts) <= TIMESTAMP '2024-01-17' AS ready FROM events GROUP BY 1")


def _candidates(s, d, keep: Column):
    return table(s, d, "part").filter(keep).select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" ?")).alias("question"), F.concat(F.lit("select "), "p_type").alias("sql"))


register("L11_publication", lambda s, d: publication(_candidates(s, d, F.col("p_partkey") % 2 == 0), _candidates(s, d, F.col("p_partkey") < 40)), """
WITH p AS (SELECT p_partkey AS id, replace(p_name, ' ', '') AS q, lower(p_type) AS s FROM part), pub AS (SELECT * FROM p WHERE id < 40), c AS (SELECT *, min(id) OVER (PARTITION BY q, s) AS first FROM p WHERE id % 2 = 0)
SELECT id, CASE WHEN id <> first OR (q, s) IN (SELECT (q, s) FROM pub) THEN 'superseded' WHEN q IN (SELECT q FROM pub) THEN 'review' ELSE 'publish' END AS state FROM c""")


def _repairs(s, d):
    k = F.col("p_partkey")
    rows = table(s, d, "part").select(F.when(k % 2 == 0, "public").when(k % 4 == 1, "").alias("schema"), F.concat(F.lit("t"), (k % 97).cast("string")).alias("table"), F.when(F.col("p_size") > 30, F.col("p_brand")).otherwise("").alias("note"))
    return repair_keys(rows, ["note"])


register("L13_key_repair", _repairs, """
WITH r AS (SELECT p_partkey % 2 = 0 AS named, concat('t', p_partkey % 97) AS t, CASE WHEN p_size > 30 THEN p_brand END AS note FROM part)
SELECT 'public' AS schema, t AS "table", coalesce(max(note) FILTER (named), max(note) FILTER (NOT named)) AS note FROM r GROUP BY t HAVING bool_or(named)""")
_half = lambda s, d, m: table(s, d, "part").filter(F.col("p_partkey") % 7 != m).select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 11 != m, F.col("p_name")).alias("a"))
register("L16_reconcile", lambda s, d: reconcile(_half(s, d, 1), _half(s, d, 2), ["a"]),
         "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 2 THEN 'draft only' WHEN 1 THEN 'review only' ELSE 'differs' END AS state FROM part WHERE p_partkey % 7 IN (1, 2) OR p_partkey % 11 IN (1, 2)")
_rec = lambda s, d, keep, body: table(s, d, "part").filter(keep).select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("batch"), F.col(body).alias("body"))
register("B5_write_plan", lambda s, d: write_plan(_rec(s, d, F.lit(True), "p_name").withColumn("batch", F.lit(1).cast("long")), _rec(s, d, F.col("p_partkey") % 2 == 0, "p_name").withColumn("body", F.when(F.col("id") % 5 > 0, F.col("body")).otherwise("x"))),
         "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 <> 0 THEN 'create' WHEN p_partkey % 5 = 0 THEN 'conflict' WHEN p_partkey % 3 = 1 THEN 'resume' ELSE 'other_batch' END AS action FROM part")
register("B6_memory_plan", lambda s, d: memory_plan(_rec(s, d, F.col("p_partkey") % 7 > 0, "p_name"), _rec(s, d, F.col("p_partkey") % 5 > 0, "p_name").withColumn("body", F.when(F.col("id") % 3 > 0, F.col("body")).otherwise("x"))),
         "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'create' WHEN p_partkey % 7 = 0 THEN 'removed' WHEN p_partkey % 3 > 0 THEN 'unchanged' ELSE 'changed' END AS action FROM part WHERE p_partkey % 7 > 0 OR p_partkey % 5 > 0")


def _memory(s, d):
    e = table(s, d, "embeddings")
    query = e.filter("vec_id = 7").select("embedding").first()[0]  # one vector
    return similar(e.filter("vec_id <> 7"), query, 10, 0.1).select("vec_id", F.round("cosine", 6).alias("cosine"))


MEMORY_SQL = """
WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id = 7), c AS (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q.e) AS cosine FROM embeddings, q WHERE vec_id <> 7)
SELECT vec_id, round(cosine, 6) AS cosine FROM c WHERE cosine >= 0.1 ORDER BY c.cosine DESC, vec_id LIMIT 10"""
register("K1_memory_search", _memory, MEMORY_SQL)


def _stored(s, d):
    """The same search through a store of all vectors: the cells, codes and vectors that may count, and exactly."""
    e = table(s, d, "embeddings")
    query = e.filter("vec_id = 7").select("embedding").first()[0]  # one vector
    store = VectorStore.create(e.filter("vec_id <> 7"), f"{shared_folder(s)}/sparkloom-vectors/{uuid.uuid4().hex}")
    return store.search(query, 10, 0.1).select(F.col("key").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


register("K1_stored_search", _stored, MEMORY_SQL)
register("K2_examples", lambda s, d: table(s, d, "part").filter("p_type = 'SMALL'").orderBy(F.col("p_name") != "blue bolt", F.desc("p_retailprice"), "p_partkey").limit(5).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL' ORDER BY p_name <> 'blue bolt', p_retailprice DESC, p_partkey LIMIT 5")
register("K3_record_id", lambda s, d: table(s, d, "part").select("p_partkey", record_id(F.lit("src"), F.col("p_brand"), F.col("p_name")).alias("id")), "SELECT p_partkey, concat('b5-', sha256(concat('src|', p_brand, '|', p_name))) AS id FROM part")
_secrets = lambda s, d: table(s, d, "part").select(
    "p_partkey", F.concat(F.lit("Authorization: Bearer abc."), "p_name").alias("header"), F.concat(F.lit("use sk-live_12345678"), F.lit(" or postgresql://u:p@h/db'; "), "p_name").alias("text"), F.col("p_name").alias("Password"),
    F.array(F.struct(F.col("p_brand").alias("api_key"), F.concat("p_type", F.lit(" sk-short")).alias("note"))).alias("calls"), F.create_map(F.lit("Cookie"), "p_name", F.lit("k"), "p_type").alias("meta"))
register("K4_redacted", lambda s, d: redacted(_secrets(s, d)).select("p_partkey", "header", "text", "Password", F.to_json("calls").alias("calls"), F.to_json("meta").alias("meta")), """
SELECT p_partkey, 'Authorization: Bearer [REDACTED] ' || split_part(p_name, ' ', 2) AS header, 'use [REDACTED] or [REDACTED_CONNECTION_STRING]''; ' || p_name AS text, '[REDACTED]' AS "Password",
  '[{"api_key":"[REDACTED]","note":"' || p_type || ' sk-short"}]' AS calls, '{"Cookie":"[REDACTED]","k":"' || p_type || '"}' AS meta FROM part""")
register("M8_families", lambda s, d: families(table(s, d, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.when(F.col("p_partkey") % 2 == 0, "day").otherwise(F.concat(F.lit("x_v"), F.col("p_size").cast("string")))).alias("table")).distinct()), """
WITH t AS (SELECT DISTINCT concat(replace(p_name, ' ', '_'), '_', CASE WHEN p_partkey % 2 = 0 THEN 'day' ELSE concat('x_v', p_size) END) AS t, replace(p_name, ' ', '_') AS f FROM part)
SELECT t AS "table", CASE WHEN count(*) OVER (PARTITION BY f) > 1 THEN f ELSE '' END AS family FROM t""")
register("M11_compact", lambda s, d: table(s, d, "part").select("p_partkey", compact(F.concat("p_brand", F.lit(" - "), "p_name")).alias("t")), "SELECT p_partkey, lower(concat(replace(p_brand, '#', ''), replace(p_name, ' ', ''))) AS t FROM part")


def _ranked(s, d):
    from ..sources.tables import metadata

    return rank_columns(metadata(s, d), "customer o_custkey and c_name please")


register("M2_rank_columns", _ranked)
_TERMS = (("red", "name", "red"), ("red", "alias", "rod"), ("red", "alias", "ring"), ("blue", "name", "blue"), ("blue", "alias", "gear"))
register("I4_source_points", lambda s, d: source_points(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), s.createDataFrame(_TERMS, "source string, kind string, term string")), """
WITH h AS (SELECT p_partkey AS id, source, kind FROM part JOIN (VALUES """ + ", ".join(map(str, _TERMS)) + """) AS t(source, kind, term) ON contains(p_name, term))
SELECT id, source, CAST(5 * count(*) FILTER (kind = 'name') + CASE WHEN count(*) FILTER (kind = 'alias') > 0 THEN 4 + least(6, 2 * count(*) FILTER (kind = 'alias')) ELSE 0 END AS BIGINT) AS points FROM h GROUP BY 1, 2""")
register("I5_suggestion", lambda s, d: suggest(table(s, d, "nation").select(F.col("n_name").alias("source"), (F.col("n_nationkey") % 23).alias("points")), "NATION_2"), "SELECT n_name AS source, coalesce((SELECT max(n_nationkey % 23) FROM nation WHERE n_name = 'NATION_2'), 0) <= 4 AND n_nationkey % 23 >= 6 AND n_nationkey % 23 - coalesce(lead(n_nationkey % 23) OVER (ORDER BY n_nationkey % 23 DESC, n_name), 0) >= 3 AS suggested FROM nation WHERE n_name <> 'NATION_2' ORDER BY n_nationkey % 23 DESC, n_name LIMIT 1")
register("Q1_date_literals", lambda s, d: table(s, d, "orders").select("o_orderkey", F.array_join(date_literals(F.concat(F.lit("t >= '"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("' and t < '2030-01-01'"))), ",").alias("dates")), "SELECT o_orderkey, concat(strftime(o_orderdate, '%Y-%m-%d'), ',2030-01-01') AS dates FROM orders")
register("Q2_latest_day", lambda s, d: table(s, d, "events").agg(F.max(F.to_date("ts")).alias("day")), "SELECT max(CAST(ts AS DATE)) AS day FROM events")
register("Q4_ranges", lambda s, d: table(s, d, "orders").select("o_orderkey", *[c.alias(n) for c, n in zip((*window_of(F.to_date("o_orderdate"), 7), *month_of(F.to_date("o_orderdate"))), ("w0", "w1", "m0", "m1"))]),
         "SELECT o_orderkey, CAST(o_orderdate AS DATE) - 6 AS w0, CAST(o_orderdate AS DATE) + 1 AS w1, CAST(date_trunc('month', o_orderdate) AS DATE) AS m0, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS m1 FROM orders")
register("Q5_seeded_sample", lambda s, d: seeded(table(s, d, "part").select("p_partkey"), "p_partkey", "today", 8), "SELECT p_partkey FROM part ORDER BY sha256(concat('today|', p_partkey)), p_partkey LIMIT 8")
