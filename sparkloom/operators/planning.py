"""Chart plans of many results at once: the planner's rules as a table, a rule holding when all its conditions are met."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.planner import RECOMMENDED, VARIANTS
from ..registry import register
from ..sources.tables import table

_RULES = T.StructType([T.StructField(*x) for x in (("place", T.IntegerType()), ("chart", T.StringType()), ("variant", T.StringType()), ("transform", T.StringType()), ("archetype", T.StringType()), ("suits", T.DoubleType()), ("needs", T.ArrayType(T.LongType())))])
_CONDITIONS = T.StructType([T.StructField(*x) for x in (("trait", T.StringType()), ("low", T.DoubleType()), ("high", T.DoubleType()), ("want_flag", T.BooleanType()), ("want_text", T.StringType()), ("word", T.IntegerType()), ("bit", T.LongType()))])
#: Fixed value: conditions to a word of bits.
_BITS = 62


def _condition(trait: str, need) -> tuple:
    low, high = (tuple(None if x is None else float(x) for x in need)) if isinstance(need, tuple) else (None, None)
    return trait, low, high, need if isinstance(need, bool) else None, need if isinstance(need, str) else None


def rules(spark: SparkSession, variants=VARIANTS) -> tuple[DataFrame, DataFrame, int]:
    """The planner's variants as rows, one for each archetype, with the bits of their conditions; their different conditions
    as rows, a range, a flag or a text, with a bit each; and the words that the bits take."""
    numbers = {c: i for i, c in enumerate(dict.fromkeys(_condition(*x) for v in variants for x in v.needs.items()))}
    words = 1 + max(0, len(numbers) - 1) // _BITS
    rows = []
    for i, v in enumerate(variants):
        needs = [0] * words
        for n in (numbers[_condition(*x)] for x in v.needs.items()):
            needs[n // _BITS] |= 1 << n % _BITS
        rows += [(i, v.chart, v.name, v.transform, a, x, needs) for a, x in v.suits.items()]
    return spark.createDataFrame(rows, _RULES), spark.createDataFrame([(*c, n // _BITS, 1 << n % _BITS) for c, n in numbers.items()], _CONDITIONS), words


def core_plans(results: DataFrame, traits: DataFrame, variants=VARIANTS) -> DataFrame:
    """result, rank, chart, variant, transform, suitability, recommended of every variant that fits a result, best first.

    results: result, archetype, wanted (a type that was asked for, or null). traits: result, trait, number, flag, text; a
    trait that isn't there meets no condition. Rules are few: their conditions are joined to the traits, the bits of met ones
    put together for each result, and a rule holds when its own are among them. A million results are two joins and one row
    each between them; nothing is on the driver.
    """
    rule, condition, words = rules(results.sparkSession, variants)
    number = F.when(~F.isnan("number") & (F.abs("number") < float("inf")), F.col("number"))
    between = F.when(F.col("low").isNull() & F.col("high").isNull(), F.lit(None)).otherwise(number.isNotNull() & (number >= F.coalesce("low", number)) & (number <= F.coalesce("high", number)))
    met = F.coalesce(between, F.col("flag") == F.col("want_flag"), F.col("text") == F.col("want_text"), F.lit(False))
    # as many rows as the planner has rules and conditions
    bits = [F.bit_or(F.when(F.col("word") == w, F.col("bit"))).alias(f"met{w}") for w in range(words)]
    held = traits.join(F.broadcast(condition), "trait").filter(met).groupBy("result").agg(*bits)
    suited = results.join(held.hint("merge"), "result", "left").join(F.broadcast(rule), "archetype")
    fits = suited.filter(reduce(and_, [F.coalesce(f"met{w}", F.lit(0)).bitwiseAND(F.col("needs")[w]) == F.col("needs")[w] for w in range(words)]))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("suits") + F.when(F.col("chart") == F.col("wanted"), 0.1).otherwise(0.0)))
    ranked = fits.withColumn("suitability", score).withColumn("rank", F.row_number().over(Window.partitionBy("result").orderBy(F.desc("suitability"), "place")))
    return ranked.select("result", "rank", "chart", "variant", "transform", "suitability", ((F.col("rank") == 1) & (F.col("suitability") >= RECOMMENDED)).alias("recommended"))


_ARCHETYPES = ("categorical_series", "temporal_series", "detail_rows", "numeric_relationship", "categorical_matrix", "multi_series_temporal", "single_value", "empty")


def _results(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each part stands for a result; its numbers give the traits."""
    k, size = F.col("p_partkey"), F.col("p_size")
    part = table(s, d, "part")
    wanted = F.when(k % 5 == 0, "area").when(k % 5 == 1, "pie")
    results = part.select(k.alias("result"), F.element_at(F.array(*map(F.lit, _ARCHETYPES)), (k % len(_ARCHETYPES) + 1).cast("int")).alias("archetype"), wanted.alias("wanted"))
    number = lambda name, value: F.struct(F.lit(name).alias("trait"), value.cast("double").alias("number"), F.lit(None).cast("boolean").alias("flag"))
    flag = lambda name, value: F.struct(F.lit(name).alias("trait"), F.lit(None).cast("double").alias("number"), value.alias("flag"))
    all_traits = F.array(number("measures", size % 5), number("categories", F.when(k % 7 > 0, size % 20)), number("time_points", size % 4), number("entities", k % 3), number("completeness", (size % 11) / 10), number("dimensions", k % 2),
                         flag("additive", k % 4 > 0), flag("part_to_whole", k % 3 > 0), flag("matrix", F.when(k % 6 > 0, size % 2 == 0)), flag("grouped_samples", size % 3 == 0))
    traits = part.select(k.alias("result"), F.inline(all_traits)).filter("number IS NOT NULL OR flag IS NOT NULL").withColumn("text", F.lit(None).cast("string"))
    return results, traits


def _sql() -> str:
    """The same in SQL: a condition is written out for each variant."""
    def one(name: str, need) -> str:
        if isinstance(need, tuple):
            return " AND ".join([f"{name} IS NOT NULL"] + [f"{name} {op} {x}" for op, x in ((">=", need[0]), ("<=", need[1])) if x is not None])
        return f"{name} = {str(need).lower()}"

    branches = [f"SELECT k AS result, {i} AS place, '{v.chart}' AS chart, '{v.name}' AS variant, '{v.transform}' AS transform, least(1.0, {x} + CASE WHEN wanted = '{v.chart}' THEN 0.1 ELSE 0 END)::DOUBLE AS suitability FROM t WHERE archetype = '{a}'" + "".join(f" AND {one(n, w)}" for n, w in v.needs.items())
                for i, v in enumerate(VARIANTS) for a, x in v.suits.items()]
    return f"""
WITH t AS (SELECT p_partkey AS k, {list(_ARCHETYPES)}[p_partkey % {len(_ARCHETYPES)} + 1] AS archetype, CASE p_partkey % 5 WHEN 0 THEN 'area' WHEN 1 THEN 'pie' END AS wanted, p_size % 5 AS measures, CASE WHEN p_partkey % 7 > 0 THEN p_size % 20 END AS categories,
  p_size % 4 AS time_points, p_partkey % 3 AS entities, (p_size % 11) / 10 AS completeness, p_partkey % 2 AS dimensions, p_partkey % 4 > 0 AS additive, p_partkey % 3 > 0 AS part_to_whole, CASE WHEN p_partkey % 6 > 0 THEN p_size % 2 = 0 END AS matrix, p_size % 3 = 0 AS grouped_samples FROM part),
f AS ({" UNION ALL ".join(branches)}), r AS (SELECT *, row_number() OVER (PARTITION BY result ORDER BY suitability DESC, place) AS rank FROM f)
SELECT result, CAST(rank AS INTEGER) AS rank, chart, variant, transform, round(suitability, 6) AS suitability, rank = 1 AND suitability >= {RECOMMENDED} AS recommended FROM r"""


register("H8_core_plans", lambda s, d: core_plans(*_results(s, d)).withColumn("suitability", F.round("suitability", 6)), _sql())
