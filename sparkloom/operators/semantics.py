"""What names and shapes of results mean: identifiers, entities, measures, shape, aggregation and detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import register
from ..sources.tables import table

#: Forms of identifiers' names.
IDENTIFIER = "(?i)^id$|_id$|编号|编码|code"
#: Words in the names of entities, best layer first, and words that exclude a name.
ENTITY_LAYERS = (
    ("排口名称", "监测点名称", "站点名称", "断面名称", "水厂名称"), ("企业名称", "公司名称", "单位名称", "项目名称"), ("名称", "name"),
    ("排口", "监测点", "站点", "断面", "企业", "公司", "水厂", "项目", "site", "station", "company"),
)
NOT_ENTITY = ("数量", "个数", "总数", "次数", "金额", "浓度", "含量", "值", "比例", "占比", "平均", "均值", "总量", "排放量", "面积", "长度", "编号", "编码", "id")
#: Words in the names of regions, and words that exclude a name.
REGION = ("区县", "地区", "区域", "行政区", "城市", "city", "region", "district")
NOT_REGION = ("数量", "面积", "金额", "值", "率", "比例", "占比", "编号", "编码", "id")
#: Forms of names of measures that can't be added up, and that can.
NOT_ADDITIVE = (
    "(?i:pH)|水位|高程|标高|温度|气温|水温|浓度|含量|密度|流量|排放量|用水量|供水量|发电量|速度|速率|流速|沉降|位移|变形|面积|长度|容积|库容|比例|占比|百分比|比率|平均值|均值|平均|指数|系数|等级|评分|得分|率$"
)
ADDITIVE = "数量|个数|总数|次数|人数|金额|收入|支出|排放总量"
NOT_ADDITIVE_WORDS = ("avg", "average", "mean", "rate", "ratio", "percent", "percentage", "min", "max")
ADDITIVE_WORDS = ("count", "sum", "total")
#: Words in names of columns of details.
DETAIL = ("明细", "记录", "列表", "原始", "detail", "raw", "log")
#: Words of statistics as values, names of their column, and ends of values of one kind.
STATISTICS = ("总数", "数量", "个数", "记录数", "平均", "均值", "平均每个", "最大", "最大值", "最小", "最小值", "合计", "总计", "中位数", "比例", "占比")
STATISTIC_NAMES = ("指标", "统计项", "统计指标", "统计口径", "metric", "measure")
ONE_KIND = ("区", "县", "市", "省", "月", "季度", "年", "站", "厂", "公司", "企业")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(w.lower() for w in words))


def identifier(name: Column) -> Column:
    """Whether a column's name is that of an identifier."""
    return name.rlike(IDENTIFIER)


def entity_layer(name: Column) -> Column:
    """How well a name names an entity: 1 is best, null is not at all."""
    out = F.when(_has(name, NOT_ENTITY), None)
    for k, words in enumerate(ENTITY_LAYERS, 1):
        out = out.when(_has(name, words), k)
    return out


def region(name: Column) -> Column:
    """Whether a name names a region."""
    return _has(name, REGION) & ~_has(name, NOT_REGION)


def naming_fields(fields: DataFrame) -> DataFrame:
    """Per result: entity and region, the fields that name the rows, or null. Needs: result, place, field, numeric.

    Numeric fields name nothing; the best layer, then the first place counts for entities, the first place for regions."""
    text = fields.filter(~F.col("numeric")).withColumns({"layer": entity_layer(F.col("field")), "is_region": region(F.col("field"))})
    best = text.groupBy("result").agg(F.min(F.when(F.col("layer").isNotNull(), F.struct("layer", "place", "field"))).alias("e"), F.min(F.when(F.col("is_region"), F.struct("place", "field"))).alias("r"))
    return fields.select("result").distinct().join(best, "result", "left").select("result", F.col("e.field").alias("entity"), F.col("r.field").alias("region"))


def measure_kind(name: Column, words: bool = True) -> Column:
    """additive, non_additive or unknown, by a measure's name without its aggregate's ending; English words come last."""
    bare = F.regexp_replace(name, "_(avg|sum|count|min|max|total)$", "")
    token = lambda ws: F.lower(name).rlike(f"(^|_)({'|'.join(ws)})(_|$)")
    out = F.when(bare.rlike(NOT_ADDITIVE), "non_additive").when(bare.rlike(ADDITIVE), "additive")
    if words:
        out = out.when(token(NOT_ADDITIVE_WORDS), "non_additive").when(token(ADDITIVE_WORDS), "additive")
    return out.otherwise("unknown")


def shape(facts: DataFrame) -> DataFrame:
    """facts with shape. Needs: columns, rows, measures (counts), by (entity, other or null: what rows are compared by), values
    and most (distinct values of that field and the rows of the most frequent), times (most distinct values of a time field)."""
    c = F.col
    some, many = c("measures") > 0, c("times") >= 2
    entity = F.coalesce(c("by") == "entity", F.lit(False))
    kind = (F.when((c("columns") == 0) | (c("rows") == 0), "empty").when((c("rows") == 1) & some, "single_value")
            .when(c("by").isNotNull() & some & (c("values") > 1) & (c("most") == 1), "cross_section")
            .when(entity & some & many & (c("values") <= 1), "single_entity_time_series").when(entity & some & many & (c("most") > 1), "multi_entity_time_series")
            .when(~entity & some & many, "single_entity_time_series").when(c("measures") >= 2, "relationship").otherwise("unknown"))
    return facts.withColumn("shape", kind)


def aggregation_state(repeats: Column, columns: Column, measures: Column, identifiers: Column, rows: Column) -> Column:
    """aggregated, raw or unknown: which has more evidence. repeats: whether keys repeat; columns, measures: arrays of
    names; identifiers: how many there are."""
    ends = lambda p: (F.size(measures) > 0) & F.forall(measures, lambda m: m.rlike(p))
    exact, loose = ends("_(sum|count|avg|min|max|total)$"), ends("(?i)_(sum|count|avg|average|mean|min|max|total)$")
    one = lambda c, n=1: F.when(c, n).otherwise(0)
    made = one(~repeats, 2) + one(exact, 2) + one(loose & ~exact)
    raw = one(repeats) + one(identifiers > 0, 2) + one((rows > 50) & (F.size(measures) <= 1)) + one(F.exists(columns, lambda c: _has(c, DETAIL)))
    return F.when(made > raw, "aggregated").when(raw > made, "raw").otherwise("unknown")


def detail_confidence(identifiers: Column, state: Column, dimensions: Column, repeats: Column, rows: Column, samples: Column, kinds: Column) -> Column:
    """How sure it is that rows are details, 0 to 1. samples: whether rows are grouped samples; kinds: the measures' kinds."""
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    total = (plus(identifiers > 0, 0.3) + plus(state != "aggregated", 0.3) + plus(dimensions == 0, 0.2) + plus(repeats & (rows >= 20), 0.2) + plus(samples, 0.2)
             + plus(repeats & (F.size(kinds) == 1) & (F.get(kinds, F.lit(0)) == "additive") & (state != "aggregated"), 0.2) - plus((state == "aggregated") & ~repeats, 0.3))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 2)


def heterogeneous_confidence(rows: Column, measures: Column, dimensions: Column, name: Column, values: Column) -> Column:
    """How sure it is that each row tells another statistic, 0 to 1: two to ten rows, one measure, one dimension.

    name, values: of the dimension, a value for each row, null or "" where there is none."""
    full = F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")
    said = F.filter(full, lambda v: _has(v, STATISTICS))
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    distinct = F.size(F.array_distinct(F.transform(values, lambda v: F.coalesce(v, F.lit("")))))
    same = (F.size(full) > 0) & F.forall(full, lambda v: v.rlike(f"({'|'.join(ONE_KIND)})$"))
    plain = (F.size(full) > 3) & F.forall(full, lambda v: F.length(v).between(3, 20)) & (F.size(said) == 0)
    total = (plus(_has(name, STATISTIC_NAMES), 0.4) + F.when(F.size(said) >= 2, 0.3).when((F.size(said) == 1) & (F.size(full) <= 4), 0.15).otherwise(0.0)
             + plus(distinct == rows, 0.2) - plus(same, 0.4) - plus(plain, 0.2))
    fits = rows.between(2, 10) & (measures == 1) & (dimensions == 1)
    return F.when(fits, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 2)).otherwise(0.0)


_NAMES = ("id", "station_id", "站点名称", "name", "pH_avg", "amount_sum", "排放总量", "city", "行政区编码", "avg_rate", "order_count", "max_temp", "company", "total", "站点数量", "rate")


def _named(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, _NAMES)), (F.col("o_orderkey") % 16).cast("int")).alias("name"))


register("C5_identifier", lambda s, d: _named(s, d).select("o_orderkey", identifier(F.col("name")).alias("identifier")), "SELECT o_orderkey, o_orderkey % 16 IN (0, 1, 8) AS identifier FROM orders")
register("C6_entity_layer", lambda s, d: _named(s, d).select("o_orderkey", entity_layer(F.col("name")).alias("layer"), region(F.col("name")).alias("region")),
         "SELECT o_orderkey, CAST(CASE o_orderkey % 16 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 12 THEN 4 END AS INTEGER) AS layer, o_orderkey % 16 = 7 AS region FROM orders")
register("C6_naming_fields", lambda s, d: naming_fields(_named(s, d).select(F.floor(F.col("o_orderkey") / 5).cast("long").alias("result"), F.col("o_orderkey").alias("place"), F.col("name").alias("field"), F.col("name").rlike("_").alias("numeric"))), """
WITH f AS (SELECT o_orderkey // 5 AS result, o_orderkey AS place, o_orderkey % 16 AS k FROM orders)
SELECT result, CASE arg_min(k, CASE k WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 12 THEN 4 END::BIGINT * 1000000000 + place) FILTER (k IN (2, 3, 12)) WHEN 2 THEN '站点名称' WHEN 3 THEN 'name' WHEN 12 THEN 'company' END AS entity,
  CASE WHEN count(*) FILTER (k = 7) > 0 THEN 'city' END AS region FROM f GROUP BY result""")
register("C8_measure_kind", lambda s, d: _named(s, d).select("o_orderkey", measure_kind(F.col("name")).alias("kind"), measure_kind(F.col("name"), words=False).alias("first")), """
SELECT o_orderkey, CASE WHEN o_orderkey % 16 IN (4, 9, 11, 15) THEN 'non_additive' WHEN o_orderkey % 16 IN (5, 6, 10, 13, 14) THEN 'additive' ELSE 'unknown' END AS kind,
  CASE WHEN o_orderkey % 16 = 4 THEN 'non_additive' WHEN o_orderkey % 16 IN (6, 14) THEN 'additive' ELSE 'unknown' END AS first FROM orders""")
_facts = lambda s, d: table(s, d, "orders").select(
    "o_orderkey", (F.col("o_orderkey") % 5).alias("columns"), (F.col("o_orderkey") % 7).alias("rows"), (F.col("o_orderkey") % 3).alias("measures"), F.get(F.array(F.lit("entity"), F.lit("other"), F.lit(None)), (F.col("o_custkey") % 3).cast("int")).alias("by"),
    (F.col("o_custkey") % 4).alias("values"), (F.col("o_custkey") % 2 + 1).alias("most"), (F.col("o_orderkey") % 4).alias("times"))
register("C9_shape", lambda s, d: shape(_facts(s, d)).select("o_orderkey", "shape"), """
WITH f AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderkey % 3 > 0 AS has, o_orderkey % 4 >= 2 AS late, o_custkey % 3 AS b, o_custkey % 4 AS v, o_custkey % 2 = 0 AS once FROM orders)
SELECT o AS o_orderkey, CASE WHEN o % 5 = 0 OR o % 7 = 0 THEN 'empty' WHEN o % 7 = 1 AND has THEN 'single_value' WHEN b < 2 AND has AND v > 1 AND once THEN 'cross_section'
  WHEN has AND late AND (b <> 0 OR v <= 1) THEN 'single_entity_time_series' WHEN has AND late AND NOT once THEN 'multi_entity_time_series' WHEN o % 3 = 2 THEN 'relationship' ELSE 'unknown' END AS shape FROM f""")
_lists = "get(array(array('price_sum'), array('price_mean', 'n_total'), array('ph')), int(o_orderkey % 3))"
_state = lambda: aggregation_state(F.col("o_custkey") % 2 == 0, F.expr("get(array(array('a', 'raw_a'), array('a')), int(o_custkey % 5 % 2))"), F.expr(_lists), F.col("o_orderkey") % 4 % 2, F.col("o_custkey") % 100)
register("C17_aggregation_state", lambda s, d: table(s, d, "orders").select("o_orderkey", _state().alias("state")), """
WITH p AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 <> 0 THEN 2 ELSE 0 END + CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS made,
  CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 2 = 1 THEN 2 ELSE 0 END + CASE WHEN o_custkey % 100 > 50 AND o_orderkey % 3 <> 1 THEN 1 ELSE 0 END + CASE WHEN o_custkey % 5 IN (0, 2, 4) THEN 1 ELSE 0 END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN made > raw THEN 'aggregated' WHEN raw > made THEN 'raw' ELSE 'unknown' END AS state FROM p""")
register("C18_detail_confidence", lambda s, d: table(s, d, "orders").select("o_orderkey", detail_confidence(
    F.col("o_orderkey") % 2, F.expr("get(array('aggregated', 'raw', 'unknown'), int(o_custkey % 3))"), F.col("o_orderkey") % 3, F.col("o_custkey") % 5 > 1, F.col("o_custkey") % 40, F.col("o_orderkey") % 7 == 0, F.expr("get(array(array('additive'), array('additive', 'unknown'), array('unknown')), int(o_orderkey % 5 % 3))")).alias("confidence")), """
WITH f AS (SELECT o_orderkey AS o, o_custkey % 3 = 0 AS agg, o_custkey % 5 > 1 AS rep, o_custkey FROM orders)
SELECT o AS o_orderkey, CAST(greatest(0, least(100, CASE WHEN o % 2 > 0 THEN 30 ELSE 0 END + CASE WHEN NOT agg THEN 30 ELSE 0 END + CASE WHEN o % 3 = 0 THEN 20 ELSE 0 END + CASE WHEN rep AND o_custkey % 40 >= 20 THEN 20 ELSE 0 END
  + CASE WHEN o % 7 = 0 THEN 20 ELSE 0 END + CASE WHEN rep AND o % 5 IN (0, 3) AND NOT agg THEN 20 ELSE 0 END - CASE WHEN agg AND NOT rep THEN 30 ELSE 0 END)) AS DOUBLE) / 100 AS confidence FROM f""")
register("C19_heterogeneous_confidence", lambda s, d: table(s, d, "orders").select("o_orderkey", heterogeneous_confidence(
    F.expr("CASE WHEN o_orderkey % 6 = 5 THEN 11L ELSE size(get(array(array('总数', '平均'), array('东区', '西区'), array('总数', 'b', 'c'), array('abc', 'def', 'ghi', 'jkl'), array('', 'x')), int(o_orderkey % 5))) END"), F.lit(1), F.col("o_custkey") % 2 + 1,
    F.when(F.col("o_custkey") % 3 == 0, "metric_name").otherwise("kind"), F.expr("get(array(array('总数', '平均'), array('东区', '西区'), array('总数', 'b', 'c'), array('abc', 'def', 'ghi', 'jkl'), array('', 'x')), int(o_orderkey % 5))")).alias("confidence")), """
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 6 = 5 OR o_custkey % 2 = 1 THEN 0 ELSE greatest(0, CASE WHEN o_custkey % 3 = 0 THEN 40 ELSE 0 END + 20 + CASE o_orderkey % 5 WHEN 0 THEN 30 WHEN 1 THEN -40 WHEN 2 THEN 15 WHEN 3 THEN -20 ELSE 0 END) END AS DOUBLE) / 100 AS confidence FROM orders""")
