"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, partitions_for, word_count, written


def _unit(source: Column, seed: int) -> Column:
    """A source's random offset in [0, 1): 32 bits of a hash of its name and the seed."""
    named = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = (3, 1, 2),
                   share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: source, source_size, target.

    Sources in code-point order, null last, get `weights` in turn and split `share` times the total size by them.
    No target is above `cap` times its source's size: what is cut off goes to the others by weight, until none is above.
    This is min(cap * size, level * weight) for one level, found by a few sums over the per-source table.
    """
    totals = sized.groupBy(source).agg(F.sum(size).alias("source_size"), F.count("*").alias("_rows"))
    order = [F.col(source).isNull(), F.col(source)]
    ranked = global_rank(totals, order, 8, "_source_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_source_rank") - 1) % len(weights) + 1).cast("int"))
    table = written(ranked.withColumn("_weight", weight), "sources")
    most = F.lit(cap) * F.col("source_size")
    row = table.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    total = share * (row["size"] or 0)
    level, capped = (total / row["weight"] if row["weight"] else 0.0), -1
    while True:  # each turn caps at least one more source, or ends
        over = most <= F.lit(level) * F.col("_weight")
        got = table.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most)).alias("used"),
                        F.sum(F.when(~over, F.col("_weight"))).alias("left")).first()
        if got["n"] == capped or not got["left"]:
            break
        capped, level = got["n"], (total - (got["used"] or 0.0)) / got["left"]
    return table.select(source, "source_size", "_rows", F.least(most, F.lit(level) * F.col("_weight")).alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """How often each row of docs enters the mix: doc_id, source, size, source_size, target, copies, taken.

    Expected copies of a row are target / source_size, the same within a source, so the prefix sum at the r-th row of a
    source is r * expected. Rows are ordered by size, then doc_id: neighbours weigh alike, so the taken words stay near
    the target. One offset is added per source; a row enters once for each integer that its step crosses, so at most
    ceil(expected) <= cap times. Ranks come from written ranges; no source meets in one task.

    Null text has size 0. Null source is a source of its own. Rows that repeat a doc_id count each. Size-0 rows take 0
    words. An empty table gives no rows. A rerun gives the same result.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sized = written(sized, "sizes")
    targets = source_targets(sized, weights=weights, share=share, cap=cap)
    order = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("doc_id")]
    ranked = global_rank(sized, order, partitions_for(sized.count(), 200_000, 8))
    # where each source starts in that order: the rows of the sources before it
    starts = global_rank(targets, order[:2], 8, "_nth")
    first = ranked.groupBy("source").agg(F.min("rank").alias("_first"))
    by_source = starts.join(first, starts["source"].eqNullSafe(first["source"])).drop(first["source"]).drop("_nth", "_rows")
    joined = ranked.join(by_source, ranked["source"].eqNullSafe(by_source["source"])).drop(by_source["source"])
    expected = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    nth, at = F.col("rank") - F.col("_first") + 1, _unit(F.col("source"), seed)
    copies = F.floor(at + expected * nth) - F.floor(at + expected * (nth - 1))
    return joined.select("doc_id", "source", "size", "source_size", "target",
                         F.coalesce(copies, F.lit(0)).cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **rules) -> DataFrame:
    """The rows of docs, each as often as mix_sources() takes it.

    Copies are looked up by id and size. Rows that share both are taken as often as all of them together, dealt by turns.
    """
    plan = mix_sources(docs, doc_id, text, source, **rules).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_copies", "_rows").filter("_copies > 0")
    rows = docs.withColumn("_n", word_count(F.col(text)))
    taken = rows.join(plan, F.col(doc_id).eqNullSafe(F.col("_id")) & F.col(source).eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size")))
    # one row, as a rule; else the k-th of n rows gets the k-th share
    nth = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(text))
    many = taken.withColumn("_k", nth)
    share = F.floor(F.col("_copies") * F.col("_k") / F.col("_rows")) - F.floor(F.col("_copies") * (F.col("_k") - 1) / F.col("_rows"))
    return many.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(share, F.lit(0)).cast("int")))).filter(share > 0).select(*docs.columns)


#: DuckDB SQL for op8's rows: the level is that of the smallest prefix, by size a weight, that may be capped.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS w
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM totals
), levels AS (
  SELECT k, most / w AS own,
         (total - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM ordered
), found AS (SELECT level FROM levels WHERE own > level ORDER BY k LIMIT 1),
targets AS (SELECT o.source, o.source_size, least(o.most, f.level * o.w) AS target FROM ordered o, found f),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS r FROM sized
), steps AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.r, t.target / CAST(t.source_size AS DOUBLE) AS e,
         CAST(('0x' || substr(md5('17|' || coalesce('s' || r.source, 'n')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((floor(u + e * r) - floor(u + e * (r - 1))) * size AS BIGINT) AS taken FROM steps
"""
