"""The relational surface: texts that the guard lets through, run by Spark as they are.

Each text is standard SQL, so DuckDB runs the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.guard import guarded_sql
from ..registry import register as _register
from ..sources.tables import register as _views

TEXTS = {
    "R1_projection": "SELECT c_custkey AS customer, c_name AS name, c_mktsegment AS segment FROM customer",
    "R2_half_open_range": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'",
    "R3_null_or_in": "SELECT p_partkey, p_brand, p_size FROM part WHERE (p_size IN (1, 5, 9) OR nullif(p_brand, 'Brand#11') IS NULL) AND p_name IS NOT NULL",
    "R4_inner_join": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
    "R5_three_way_join": "SELECT n.n_name, r.r_name, count(*) AS customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name",
    "R6_left_join_on_filter": "SELECT c.c_custkey, count(o.o_orderkey) AS finished FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey",
    "R7_orphans": "SELECT count(*) AS orphans FROM lineitem l LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderkey IS NULL",
    "R8_semi_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "R9_exists": "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 49)",
    "R11_group_count": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "R12_group_multi_key": "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber",
    "R13_rounded_average": "SELECT l_returnflag, round(avg(l_quantity), 3) AS avg_quantity FROM lineitem GROUP BY l_returnflag",
    "R14_min_max": "SELECT c_mktsegment, max(c_acctbal) AS most, min(c_acctbal) AS least FROM customer GROUP BY c_mktsegment",
    "R15_two_distinct_counts": "SELECT c.c_mktsegment, count(DISTINCT c.c_custkey) AS customers, count(DISTINCT o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_mktsegment",
    "R16_count_column": "SELECT p_brand, count(*) AS parts, count(nullif(p_size, 1)) AS not_smallest FROM part GROUP BY p_brand",
    "R17_having": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 2",
    "R18_mixed_order": "SELECT c_mktsegment, c_nationkey, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_nationkey ASC, c_custkey ASC LIMIT 100",
    "R19_order_by_aggregate": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 20",
    "R20_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "R21_cte": "WITH spent AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) SELECT c.c_name, s.total FROM spent s JOIN customer c ON c.c_custkey = s.o_custkey WHERE s.total > 1000000",
    "R22_derived_table": "SELECT d.status, max(d.n) AS most FROM (SELECT o_custkey, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) d GROUP BY d.status",
    "R23_scalar_functions": "SELECT date_trunc('month', o_orderdate) AS month, round(sum(coalesce(o_totalprice, 0)), 2) AS total, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY date_trunc('month', o_orderdate)",
    "R25_bounding_aggregates": "SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 4) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, round(stddev(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS vp, round(var_samp(l_quantity), 4) AS vs FROM lineitem GROUP BY l_linestatus",
    "R26_case_between_like": "SELECT CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'middle' ELSE 'large' END AS band, count(*) AS n FROM part WHERE p_name LIKE '%bolt%' AND true GROUP BY 1",
    "R27_coalesce_order": "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS priority FROM orders ORDER BY coalesce(nullif(o_orderpriority, '1-URGENT'), '0') ASC, o_orderkey LIMIT 50",
    "R28_arithmetic": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem",
    "S1_scan": "SELECT event_id, user_id, event_type, value FROM events",
    "S10_row_count": "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events",
}
#: Dialects differ in these: Spark's text and DuckDB's.
PAIRS = {
    "R10_lateral_unnest": (
        "SELECT o.o_orderkey, p.place, p.part FROM orders o LATERAL VIEW posexplode(split(o.o_orderpriority, '-')) p AS place, part",
        "SELECT o_orderkey, CAST(i - 1 AS INTEGER) AS place, string_split(o_orderpriority, '-')[i] AS part FROM orders, unnest(range(1, len(string_split(o_orderpriority, '-')) + 1)) AS t(i)",
    ),
    "R24_date_functions": (
        "SELECT to_date(o_orderdate) AS day, year(o_orderdate) AS y, month(o_orderdate) AS m, date_format(o_orderdate, 'yyyy-MM') AS ym, ifnull(max(nullif(o_orderstatus, 'F')), 'none') AS s FROM orders GROUP BY 1, 2, 3, 4",
        "SELECT CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, strftime(o_orderdate, '%Y-%m') AS ym, ifnull(max(nullif(o_orderstatus, 'F')), 'none') AS s FROM orders GROUP BY 1, 2, 3, 4",
    ),
    "S6_bounded_sample": (
        "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 200",
        "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 200",
    ),
}
FLAGSHIP = """
SELECT n.n_name AS nation, count(o.o_orderkey) AS finished, round(avg(o.o_totalprice), 3) AS mean_price
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'
GROUP BY n.n_name ORDER BY count(o.o_orderkey) DESC, n.n_name LIMIT 10
"""


def _run(sql: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir)
        return guarded_sql(spark, sql)

    return query


for _name, _sql in TEXTS.items():
    _register(_name, _run(_sql), _sql)
for _name, (_sql, _duck) in PAIRS.items():
    _register(_name, _run(_sql), _duck)
#: A sum of decimals is the same in each run; the mean is then rounded as it is stored.
_MEAN = "floor(CAST(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / nullif(count(o.o_totalprice), 0) * 1000 + 0.5) / 1000"
_register("flagship", _run(FLAGSHIP.replace("round(avg(o.o_totalprice), 3)", _MEAN)), FLAGSHIP)
