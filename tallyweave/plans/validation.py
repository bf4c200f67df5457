"""Queries of rule validation."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import rules as R
from .common import table
from .registry import query

ORDER_RULES = R.parse_rules([
    {"column": "o_orderkey", "check": "unique", "name": "unique key"},
    {"column": "o_orderstatus", "check": "in", "values": ["F", "O"], "name": "status"},
    {"column": "o_totalprice", "check": "between", "min_value": 1000, "max_value": 400000, "name": "price"},
    {"column": "o_orderstatus", "check": "not_equals", "value": "P", "name": "urgent", "when": [{"column": "o_orderpriority", "operator": "equals", "value": "1-urgent"}]},
    {"column": "o_orderdate", "check": "date_not_past", "name": "recent"},
])
TODAY = datetime.date(1995, 1, 1)


def order_issues(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_num"), "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    return R.validate(orders, ORDER_RULES, today=TODAY, sheet="orders")


ORDER_ISSUES = """
WITH o AS (SELECT *, lower(trim(o_orderstatus)) AS s, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
issues AS (
SELECT o_orderkey AS row_num, 'o_orderkey' AS "column", 'unique key' AS rule, 'o_orderkey must be unique.' AS message, CAST(o_orderkey AS VARCHAR) AS value FROM (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n FROM o) WHERE n > 1
UNION ALL SELECT o_orderkey, 'o_orderstatus', 'status', 'o_orderstatus must match one of the allowed values.', o_orderstatus FROM o WHERE s NOT IN ('f', 'o') OR s = ''
UNION ALL SELECT o_orderkey, 'o_totalprice', 'price', 'o_totalprice must be between 1000 and 400000.', NULL FROM o WHERE NOT coalesce(round(o_totalprice, 2) BETWEEN 1000 AND 400000, false)
UNION ALL SELECT o_orderkey, 'o_orderstatus', 'urgent', 'o_orderstatus must not equal ''P''.', o_orderstatus FROM o WHERE lower(trim(o_orderpriority)) = '1-urgent' AND s = 'p'
UNION ALL SELECT o_orderkey, 'o_orderdate', 'recent', 'o_orderdate cannot be earlier than today.', d FROM o WHERE coalesce(CAST(o_orderdate AS DATE) < DATE '1995-01-01', true))
"""


@query("validate_orders", ORDER_ISSUES + "SELECT row_num, \"column\", rule, message FROM issues")
def validate_orders(spark, sf_dir):
    return order_issues(spark, sf_dir).select("row_num", "column", "rule", "message")


@query("validate_categorised", ORDER_ISSUES + """SELECT rule, CASE WHEN message LIKE '%404%' THEN 'No Official Presence Found' ELSE 'Suspected Incorrect' END AS finding_category,
'High' AS confidence, count(*) AS issues FROM issues GROUP BY ALL""")
def validate_categorised(spark, sf_dir):
    return order_issues(spark, sf_dir).groupBy("rule", "finding_category", "confidence").agg(F.count("*").alias("issues"))


@query("qa_clean_rows", ORDER_ISSUES + "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT row_num FROM issues)")
def qa_clean_rows(spark, sf_dir):
    return R.clean_rows(table(spark, sf_dir, "orders"), order_issues(spark, sf_dir), "o_orderkey").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("qa_metrics", ORDER_ISSUES + "SELECT CASE WHEN grouping(rule) = 0 OR grouping(sheet) = 0 THEN 'orders' END AS sheet, rule, count(*) AS issues, count(DISTINCT row_num) AS flagged_rows FROM (SELECT 'orders' AS sheet, * FROM issues) GROUP BY ROLLUP (sheet, rule)")
def qa_metrics(spark, sf_dir):
    return R.run_metrics(order_issues(spark, sf_dir))


@query("validate_unique_conditional", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey || '-' || l_partkey % 50 AS k FROM lineitem WHERE lower(trim(l_returnflag)) = 'n')
SELECT l_orderkey, l_linenumber, k FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM l) WHERE n > 1""")
def validate_unique_conditional(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_num"), "l_returnflag", F.concat_ws("-", "l_orderkey", F.col("l_partkey") % 50).alias("k"))
    rules = R.parse_rules([{"column": "k", "check": "unique", "when": [{"column": "l_returnflag", "operator": "equals", "value": "N"}]}])
    issues = R.validate(lines, rules)
    return issues.select(F.floor(F.col("row_num") / 100).alias("l_orderkey"), (F.col("row_num") % 100).cast("int").alias("l_linenumber"), F.col("value").alias("k"))


@query("validate_text_rules", r"""
SELECT p_partkey AS row_num, 'form' AS rule, p_name AS value FROM part WHERE NOT regexp_full_match(trim(p_name), '[a-z]+ [a-z]+.*') OR trim(p_name) = ''
UNION ALL SELECT p_partkey, 'metal', p_type FROM part WHERE NOT (lower(p_type) LIKE '%brass%' OR lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%econ%')
UNION ALL SELECT p_partkey, 'holds', p_name FROM part WHERE lower(p_type) LIKE '%o%' AND NOT lower(p_name) LIKE '%a%'
UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE NOT (lower(trim(p_brand)) NOT IN ('brand#11', 'brand#22') AND trim(p_brand) <> '')""")
def validate_text_rules(spark, sf_dir):
    rules = R.parse_rules([
        {"column": "p_name", "check": "regex", "pattern": "[a-z]+ [a-z]+.*", "name": "form"},
        {"column": "p_type", "check": "contains_any", "values": ["BRASS", "steel", "econ"], "name": "metal"},
        {"column": "p_name", "check": "contains", "value": "a", "name": "holds", "when": [{"column": "p_type", "operator": "contains", "value": "O"}]},
        {"column": "p_brand", "check": "not_blank_and_not_in", "tokens": ["Brand#11", "BRAND#22"], "name": "brand"},
    ])
    parts = table(spark, sf_dir, "part").withColumn("row_num", F.col("p_partkey"))
    return R.validate(parts, rules).select("row_num", "rule", "value")
