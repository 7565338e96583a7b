"""What a question asks for: the context it needs, whether it asks for data, and whether its result may be told at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import register
from ..sources.tables import table

#: Words of questions that need all context.
COMPLEX = (
    "统计 聚合 数量 总数 平均 最大 最小 排名 排行 趋势 变化 同比 环比 原因 分析 总结 建议 对比 比较 图表 柱状图 折线图 饼图 可视化 日报 月报 周报 报告 综合 分布 占比 每个 各个 各区 各断面".split()
)
#: Subjects that need all context.
SUBJECTS = ("监测断面", "排污口类型", "排污口监测记录")
#: Words that point back to an earlier answer.
FOLLOW_UP = ("刚才", "上面", "上一", "继续", "再查", "其中", "这些", "它们", "前一")
#: Forms of plain lookups.
LOOKUP = (r"(?:前|只取|只列|列出|显示|查询|查找|有哪些).{0,20}\d+\s*(?:条|个|行)", "(?:列出|显示|查询|查找|有哪些|明细|详情|记录|名单)", r"(?:最新|最近)\s*\d+\s*(?:条|个|行)")
#: Forms that filter or order an earlier answer anew.
FRESH = (
    r"(?:只|仅)?(?:显示|保留|列出).{0,12}(?:其中|结果|前\s*\d+|后\s*\d+|最多|最少)", r"(?:刚才|上次|上一|上面|其中|这些|结果).{0,16}(?:前\s*\d+|后\s*\d+|最多|最少)",
    "(?:再|继续)(?:筛选|过滤|查询|查找|统计|排序|显示|列出)", "(?:筛选|过滤).{0,20}(?:刚才|上次|上一|上面|其中|这些|结果)",
)
#: Words of questions about an answer's meaning.
MEANING = ("解释", "说明", "什么意思", "含义", "怎么理解", "为什么", "原因")
#: Forms that ask for data whatever else they say.
OPERATION = (
    "(?:查询|查找|筛选|过滤|只看|再查|接着查|继续查)", "(?:只|再|然后|顺便|重新)(?:显示|列出|返回|取|保留)", "(?:把|将).{0,24}(?:排序|显示|筛选|过滤|列出|返回)",
    "(?:再|然后|顺便|重新)(?:按.{0,20})?(?:排序|倒序|升序|显示|列出|返回|筛选|过滤)",
)
#: Forms of greetings, thanks, and questions about an answer, a text of SQL or what was meant.
TALK = (
    "(?:你|您)?好[啊呀吗]?", "(?i:嗨|哈喽|hello|hi)[啊呀]?", "(?:早上|上午|中午|下午|晚上)?好", "(?:谢谢|感谢|多谢|辛苦了)[你您]?[了啊呀]?",
    "(?:请)?(?:解释|说明)(?:一下)?(?:刚才|上次|上一条|上面|这个|该|上述)(?:结果|回答|字段|SQL)", "(?:这个|该|上述|上面|刚才|上一条)?.{0,8}(?:字段|结果|回答|SQL).{0,8}(?:是什么意思|什么含义|怎么理解)",
    "(?i:SQL|SELECT|WHERE|JOIN|GROUPBY|ORDERBY).{0,8}(?:语法|语句|含义|是什么意思|怎么写|怎么理解)", "(?:刚才|上次|上一条|上面).{0,8}为什么.{0,12}(?:排序|显示|回答|计算)",
    "(?:请问)?(?:需要|还需要)(?:我)?(?:说明|补充|提供).{0,16}(?:什么|哪些)(?:条件|信息|范围)?[吗？?]?", "(?:你|您)是指.{1,24}[吗？?]",
)
#: SQL that is no plain lookup, and columns that can't be told in text.
COMPLEX_SQL = r"(?is)\b(group\s+by|having|union|over\s*\(|with\s+.+\bas\s*\(|join)\b"
UNSAFE_COLUMN = "(?i)(?:^|_)(?:geom|geometry|binary|blob)(?:$|_)"
#: Fixed value: rows that may be told at once.
MOST_ROWS = 50


def _plain(question: Column) -> Column:
    return F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", "")


def _any(text: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def simple_result(question: Column) -> Column:
    """Whether a question is a plain lookup that points to no earlier answer."""
    q = _plain(question)
    return (q != "") & ~_any(q, COMPLEX) & ~_any(q, FOLLOW_UP) & _any(q, LOOKUP)


def context_profile(question: Column) -> Column:
    """SIMPLE_LOOKUP for plain lookups of plain subjects, else FULL."""
    return F.when(simple_result(question) & ~_any(_plain(question), SUBJECTS), "SIMPLE_LOOKUP").otherwise("FULL")


def needs_fresh_data(question: Column) -> Column:
    """Whether a follow-up filters or orders anew; questions about meaning don't."""
    q = _plain(question)
    return (q != "") & ~_any(q, MEANING) & _any(q, FRESH)


def no_data_wanted(question: Column) -> Column:
    """Whether a question plainly asks for no data: nothing, a greeting, thanks, or what an answer means."""
    q = F.regexp_replace(_plain(question), "^[，。！？!?；;：:]+|[，。！？!?；;：:]+$", "")
    return (q == "") | ~_any(q, OPERATION) & q.rlike("^(?:" + "|".join(f"(?:{p})" for p in TALK) + ")$")


def fast_path(runs: DataFrame) -> DataFrame:
    """runs and reason: eligible, or the first thing that keeps a result from being told at once.

    Needs: question, frames, calls, errors, warnings, sql, row_count, columns (array).
    """
    reason = (F.when(~simple_result(F.col("question")), "query_requires_natural_language_answer")
              .when((F.col("calls") != 1) | (F.col("frames") != 1), "requires_exactly_one_dataframe").when(F.col("errors") > 0, "retry_or_tool_error")
              .when(F.col("warnings") > 0, "guard_warning").when(F.coalesce("sql", F.lit("")).rlike(COMPLEX_SQL), "complex_sql")
              .when(F.col("row_count").isNull() | ~F.col("row_count").between(0, MOST_ROWS), "row_count_out_of_range")
              .when(F.exists("columns", lambda c: c.rlike(UNSAFE_COLUMN)), "unsafe_column").otherwise("eligible"))
    return runs.withColumn("reason", reason)


_QUESTIONS = ("列出最近 10 条记录", "统计各区数量", "查询监测断面名单", "刚才的结果只显示前 5 条", "你好", "谢谢！", "继续筛选水质记录", "这个字段是什么意思", "为什么结果最少", "把结果按日期排序", "显示 20 个站点", "", "SELECT语句怎么写", "您是指昨天吗？", "再按月份倒序")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array(*map(F.lit, _QUESTIONS))
    return table(spark, d, "events").select("event_id", F.get(texts, (F.col("event_id") % len(_QUESTIONS)).cast("int")).alias("question"), "user_id", "value")


_ASKED = "WITH asked AS (SELECT event_id, event_id % 15 AS k, user_id, value FROM events) "
register("I1_context_profile", lambda spark, d: _asked(spark, d).select("event_id", context_profile(F.col("question")).alias("profile")),
         _ASKED + "SELECT event_id, CASE WHEN k IN (0, 10) THEN 'SIMPLE_LOOKUP' ELSE 'FULL' END AS profile FROM asked")
register("I2_question_kinds", lambda spark, d: _asked(spark, d).select("event_id", simple_result(F.col("question")).alias("simple"), needs_fresh_data(F.col("question")).alias("fresh"), no_data_wanted(F.col("question")).alias("talk")),
         _ASKED + "SELECT event_id, k IN (0, 2, 10) AS simple, k IN (3, 6) AS fresh, k IN (4, 5, 7, 11, 12, 13) AS talk FROM asked")
_SQLS = "array('SELECT a FROM t', 'SELECT a FROM t JOIN u ON t.x = u.x', 'select a from t group  by a', 'WITH c AS (SELECT 1) SELECT 1 FROM c')"
register("I3_fast_path", lambda spark, d: fast_path(_asked(spark, d).select(
    "event_id", F.lit("查询名单").alias("question"), F.lit(1).alias("calls"), (F.col("event_id") % 7 + 1).alias("frames"), (F.col("event_id") % 5 % 2).alias("errors"), F.lit(0).alias("warnings"),
    F.expr(f"get({_SQLS}, int(user_id % 4))").alias("sql"), F.when(F.col("value") < 20, F.floor("value") * 3).alias("row_count"),
    F.when(F.col("event_id") % 11 == 0, F.array(F.lit("geom"))).otherwise(F.array(F.lit("geometrical"), F.lit("name"))).alias("columns"))).select("event_id", "reason"), """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 'requires_exactly_one_dataframe' WHEN event_id % 5 IN (1, 3) THEN 'retry_or_tool_error' WHEN user_id % 4 <> 0 THEN 'complex_sql'
  WHEN value >= 20 OR floor(value) * 3 NOT BETWEEN 0 AND 50 THEN 'row_count_out_of_range' WHEN event_id % 11 = 0 THEN 'unsafe_column' ELSE 'eligible' END AS reason FROM events""")
