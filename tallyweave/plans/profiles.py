"""Queries of duplicates, profiles and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import duplicates as D
from ..operators import profile as P
from .common import table, with_checkpoints
from .registry import query


@query("exact_duplicates", r"""
WITH d AS (SELECT doc_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS k FROM documents)
SELECT doc_id AS row_id, min(doc_id) OVER w AS group_row, count(*) OVER w AS group_size FROM d WHERE k <> '' WINDOW w AS (PARTITION BY k) QUALIFY count(*) OVER w > 1""")
def exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return D.exact_duplicates(docs, ["text"]).select("row_id", "group_row", "group_size")


@query("duplicates_by_id", """
WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) AS k FROM lineitem)
SELECT row_id, min(row_id) OVER w AS group_row, count(*) OVER w AS group_size FROM l WINDOW w AS (PARTITION BY k) QUALIFY count(*) OVER w > 1""")
def duplicates_by_id(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.concat_ws("/", "l_partkey", "l_suppkey").alias("k"))
    return D.duplicates_by_id(lines, "k").select("row_id", "group_row", "group_size")


@query("duplicate_conflicts", """
WITH p AS (SELECT p_partkey AS row_num, lower(trim(p_name)) AS t, p_name, p_brand FROM part),
h AS (SELECT *, count(*) OVER (PARTITION BY lower(p_brand)) AS n, min(t) OVER (PARTITION BY lower(p_brand)) AS lo, max(t) OVER (PARTITION BY lower(p_brand)) AS hi FROM p WHERE trim(p_brand) <> '')
SELECT row_num, 'title' AS "column", 'Duplicate entity' AS kind, p_name AS value, count(*) OVER (PARTITION BY t) - 1 AS others FROM p WHERE t <> '' QUALIFY count(*) OVER (PARTITION BY t) > 1
UNION ALL SELECT row_num, 'facebook_page', 'Conflicting handle', p_brand, n - 1 FROM h WHERE lo <> hi""")
def duplicate_conflicts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_num"), F.col("p_name").alias("title"), F.col("p_brand").alias("facebook_page"))
    return D.duplicate_conflicts(parts)


NORM = "trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))"


@query("fuzzy_pairs", f"""
WITH v AS (SELECT DISTINCT {NORM} AS v FROM part)
SELECT a.v AS a, b.v AS b, round(jaro_winkler_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.v < b.v WHERE a.v <> '' AND jaro_winkler_similarity(a.v, b.v) >= 0.85""")
def fuzzy_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(T.norm_lookup(F.col("p_name")).alias("v"))
    return D.fuzzy_pairs(names, "v", 0.85).select("a", "b", F.round("similarity", 6).alias("similarity"))


# the greedy pass, a text at a time: it joins the earliest leader that is similar, or leads
@query("fuzzy_groups", f"""
WITH RECURSIVE v AS (SELECT {NORM} AS v, min(p_partkey) AS first FROM part GROUP BY 1 HAVING v <> ''),
o AS (SELECT v, first, row_number() OVER (ORDER BY first) AS i FROM v),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS leaders, CAST(NULL AS VARCHAR) AS v, CAST(NULL AS VARCHAR) AS leader
UNION ALL SELECT s.i, CASE WHEN s.m IS NULL THEN list_append(s.leaders, s.v) ELSE s.leaders END, s.v, coalesce(s.m, s.v)
FROM (SELECT o.i, o.v, g.leaders, list_filter(g.leaders, lambda l: jaro_winkler_similarity(least(l, o.v), greatest(l, o.v)) >= 0.85)[1] AS m FROM g JOIN o ON o.i = g.i + 1) s),
n AS (SELECT g.v, g.leader, o.first AS group_row, round(jaro_winkler_similarity(least(g.v, g.leader), greatest(g.v, g.leader)), 12) AS s FROM g JOIN o ON g.leader = o.v),
r AS (SELECT p_partkey AS row_id, group_row, s FROM part JOIN n ON n.v = {NORM}),
b AS (SELECT group_row, max(s) FILTER (WHERE row_id <> group_row) AS s FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT row_id, group_row, round(b.s, 4) AS similarity FROM r JOIN b USING (group_row)""")
def fuzzy_groups(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), "p_name")
    with_checkpoints(spark)
    return D.fuzzy_duplicates(parts, "p_name", 0.85)


def _health_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(count(*) FILTER (WHERE v IN ('', '\\n', 'nan', 'null')) / count(*) * 100, 2) AS missing_pct, count(DISTINCT v) FILTER (WHERE v NOT IN ('', '\\n', 'nan', 'null')) AS cardinality FROM (SELECT lower(trim(coalesce(CAST({c} AS VARCHAR), ''))) AS v FROM {name})"
        for c in columns
    )


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query("column_health", _health_sql("customer", CUSTOMER) + " UNION ALL " + _health_sql("orders", ORDERS))
def column_health(spark, sf_dir):
    return P.column_health(table(spark, sf_dir, "customer").select(CUSTOMER)).unionByName(P.column_health(table(spark, sf_dir, "orders").select(ORDERS)))


@query("date_outliers", """
WITH o AS (SELECT o_orderkey AS row_id, CAST(year(o_orderdate) + CASE WHEN o_orderkey % 100 = 7 THEN 40 WHEN o_orderkey % 100 = 8 THEN -20 ELSE 0 END AS INTEGER) AS y FROM orders),
r AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS i, count(*) OVER () AS n FROM o),
q AS (SELECT min(y) FILTER (WHERE i = floor(n * 0.25)) AS q1, min(y) FILTER (WHERE i = floor(n * 0.75)) AS q3 FROM r),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
SELECT row_id, 'released_on' AS "column", y || '-01-01' AS value, 'date_outlier' AS anomaly_type,
CASE WHEN CASE WHEN y > high THEN y - high ELSE low - y END > 10 THEN 'high' ELSE 'medium' END AS severity FROM o, b WHERE y < low OR y > high""")
def date_outliers(spark, sf_dir):
    shifted = F.year("o_orderdate") + F.when(F.col("o_orderkey") % 100 == 7, 40).when(F.col("o_orderkey") % 100 == 8, -20).otherwise(0)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.concat(shifted.cast("string"), F.lit("-01-01")).alias("released_on"))
    return P.date_outliers(orders, ["released_on"])


@query("rare_categories", """
WITH p AS (SELECT p_partkey AS row_id, p_brand || '/' || p_size AS v FROM part), c AS (SELECT lower(v) AS k, count(*) AS n FROM p GROUP BY 1)
SELECT row_id, 'category' AS "column", v AS value, 'rare_category' AS anomaly_type, 'low' AS severity FROM p JOIN c ON lower(v) = k
WHERE n <= 2 AND n / (SELECT count(*) FROM p) < 0.02 AND (SELECT count(*) FROM p) >= 10""")
def rare_categories(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.concat_ws("/", "p_brand", "p_size").alias("category"))
    return P.rare_categories(parts, ["category"])


def health_rows(spark, sf_dir):
    """Customers as a catalogue: blanks, bad URLs and dates, and shared ids at fixed keys."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("row_id"),
        F.when(k % 10 == 3, "").otherwise(F.col("c_name")).alias("title"),
        F.concat(F.lit("tt"), F.lpad((k - k % 7 % 2).cast("string"), 7, "0")).alias("imdb_id"),
        F.when(k % 6 == 1, "not a url").otherwise(F.concat(F.lit("https://example.com/"), k)).alias("wikipedia_url"),
        F.when(k % 9 == 4, "soon").otherwise(F.concat((1990 + k % 30).cast("string"), F.lit("-05-01"))).alias("released_on"),
        (1990 + k % 29).cast("string").alias("year"),
        F.col("c_mktsegment").alias("genre"),
    )
    return P.row_health_in_table(rows, "row_id")


ROW_HEALTH = r"""
WITH c AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 10 = 3 THEN '' ELSE c_name END AS title, 'tt' || lpad(CAST(c_custkey - c_custkey % 7 % 2 AS VARCHAR), 7, '0') AS imdb_id,
CASE WHEN c_custkey % 6 = 1 THEN 'not a url' ELSE 'u' END AS url, CASE WHEN c_custkey % 9 = 4 THEN 'soon' ELSE CAST(1990 + c_custkey % 30 AS VARCHAR) || '-05-01' END AS rel, CAST(1990 + c_custkey % 29 AS VARCHAR) AS y, c_mktsegment AS genre FROM customer),
s AS (SELECT row_id, (CASE WHEN title <> '' THEN 1.0::DOUBLE ELSE 0.0 END + CASE WHEN genre <> '' THEN 0.8::DOUBLE ELSE 0.0 END + 0.8::DOUBLE + 1.0::DOUBLE + 0.7::DOUBLE) / (1.0::DOUBLE + 0.8 + 0.8 + 1.0 + 0.7) * 100 AS comp,
(1.0::DOUBLE + CASE WHEN url = 'u' THEN 1 ELSE 0 END + CASE WHEN rel <> 'soon' THEN 1 ELSE 0 END) / 3 * 100 AS form,
(CASE WHEN contains(rel, y) THEN 1.0::DOUBLE ELSE 0.0 END + 1.0) / 2 * 100 AS cons, count(*) OVER (PARTITION BY imdb_id) > 1 AS dup FROM c),
h AS (SELECT row_id, round(comp, 2) AS completeness, round(form, 2) AS format_score, round(cons, 2) AS consistency, CASE WHEN dup THEN 50.0::DOUBLE ELSE 100.0::DOUBLE END AS uniqueness,
CASE WHEN dup THEN round(round(comp, 2) * 0.35::DOUBLE + round(form, 2) * 0.25::DOUBLE + round(cons, 2) * 0.20::DOUBLE + 10.0, 2) ELSE round(comp * 0.35::DOUBLE + form * 0.25::DOUBLE + cons * 0.20::DOUBLE + 20.0, 2) END AS overall_score FROM s)
"""
GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"


@query("row_health", ROW_HEALTH + f"SELECT row_id, round(completeness, 1) AS completeness, round(format_score, 1) AS format_score, consistency, uniqueness, round(overall_score, 1) AS overall_score, {GRADE.format('overall_score')} AS grade FROM h")
def row_health(spark, sf_dir):
    h = "health."
    return health_rows(spark, sf_dir).select("row_id", F.round(h + "completeness", 1).alias("completeness"), F.round(h + "format_score", 1).alias("format_score"), h + "consistency", h + "uniqueness", F.round(h + "overall_score", 1).alias("overall_score"), h + "grade")


@query("table_health", ROW_HEALTH + f"""SELECT count(*) AS rows, round(avg(completeness), 1) AS completeness, round(avg(format_score), 1) AS format_score, round(avg(consistency), 1) AS consistency, round(avg(uniqueness), 1) AS uniqueness,
count(*) FILTER (WHERE {GRADE.format('overall_score')} = 'A') AS a, count(*) FILTER (WHERE {GRADE.format('overall_score')} = 'F') AS f FROM h""")
def table_health(spark, sf_dir):
    t = P.table_health(health_rows(spark, sf_dir))
    means = [F.round(c, 1).alias(c) for c in ("completeness", "format_score", "consistency", "uniqueness")]
    return t.select("rows", *means, F.element_at("grades", F.lit("A")).alias("a"), F.element_at("grades", F.lit("F")).alias("f"))


@query("worst_columns", """SELECT * FROM (
SELECT 'title' AS "column", count(*) FILTER (WHERE c_custkey % 10 = 3) AS issues FROM customer
UNION ALL SELECT 'wikipedia_url', count(*) FILTER (WHERE c_custkey % 6 = 1) FROM customer
UNION ALL SELECT 'released_on', count(*) FILTER (WHERE c_custkey % 9 = 4) FROM customer
UNION ALL SELECT 'imdb_id', count(*) FROM (SELECT count(*) OVER (PARTITION BY c_custkey - c_custkey % 7 % 2) AS n FROM customer) WHERE n > 1
UNION ALL SELECT 'year', count(*) FROM (SELECT CASE WHEN c_custkey % 9 = 4 THEN 'soon' ELSE CAST(1990 + c_custkey % 30 AS VARCHAR) || '-05-01' END AS rel, CAST(1990 + c_custkey % 29 AS VARCHAR) AS y FROM customer) WHERE NOT contains(rel, y))
ORDER BY issues DESC, "column" LIMIT 3""")
def worst_columns(spark, sf_dir):
    return P.worst_columns(health_rows(spark, sf_dir))
