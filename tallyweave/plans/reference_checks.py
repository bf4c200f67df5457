"""Queries of the checks against reference data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookup as L
from ..operators import references as R
from .common import table
from .registry import query


def catalogue(spark, sf_dir):
    """Parts as audited rows, with flaws at fixed keys, and their reference."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    tt = lambda c: F.concat(F.lit("tt"), F.lpad(c.cast("string"), 7, "0"))
    rows = part.select(
        k.alias("row_num"), F.concat("p_name", F.lit(" "), k).alias("title"), F.when(k % 3 == 0, "movies").when(k % 3 == 1, "tv shows").otherwise("").alias("title_category"),
        F.when(k % 4 == 0, tt(k)).alias("imdb_id"), F.when(k % 10 == 1, "N/A").when(k % 10 == 2, "Drama\n").when(k % 10 == 3, "Comedy").otherwise("Sci-Fi, drama").alias("primary_genre"),
        F.when(k % 10 == 4, "1899-07-16").when(k % 10 == 5, "2012-07-16").when(k % 10 == 6, "July").otherwise("2010-07-16").alias("released_on"), F.when(k % 10 == 7, "nothing").otherwise(F.lower("p_brand")).alias("network"),
    )
    reference = part.filter(k % 5 != 0).select(
        tt(k).alias("imdb_id"), F.when(k % 2 == 0, "movie").otherwise("tv").alias("kind"), T.norm_title(F.concat("p_name", F.lit(" "), k)).alias("title_norm"), F.array(F.lit("Science Fiction"), F.lit("Drama")).alias("genres"),
        F.lit("2010-07-16").alias("release_date"), F.array(F.concat(F.lit("The "), "p_brand")).alias("networks"), F.array().cast("array<string>").alias("companies"),
    )
    return R.entity_metadata(rows, reference)


AUDIT = """
WITH p AS (SELECT p_partkey AS k, p_partkey % 10 AS m, p_partkey % 5 <> 0 AND (p_partkey % 4 = 0 OR CASE p_partkey % 3 WHEN 0 THEN p_partkey % 2 = 0 WHEN 1 THEN p_partkey % 2 = 1 ELSE true END) AS known FROM part)
"""


@query("genre_audit", AUDIT + """SELECT k AS row_num, CASE WHEN m = 1 THEN 'PLACEHOLDER: Genre contains placeholder' WHEN m = 2 THEN 'FORMAT_ERROR: Genre has trailing newlines or whitespace' WHEN NOT known THEN 'No reference data found' ELSE 'GENRE_MISMATCH: comedy' END AS message FROM p WHERE m IN (1, 2, 3) OR NOT known""")
def genre_audit(spark, sf_dir):
    return catalogue(spark, sf_dir).select("row_num", R.genre_audit(F.col("primary_genre"), F.col("entity")).alias("message")).filter("message IS NOT NULL")


@query("date_audit", AUDIT + """SELECT k AS row_num, CASE WHEN m = 4 THEN 'FORMAT_ERROR: anomalous year (suspected typo)' WHEN m = 6 THEN 'FORMAT_ERROR: Date is not in a valid format' WHEN NOT known THEN 'No reference data found' ELSE 'DATE_MISMATCH: year does not match the reference' END AS message FROM p WHERE m IN (4, 5, 6) OR NOT known""")
def date_audit(spark, sf_dir):
    return catalogue(spark, sf_dir).select("row_num", R.date_audit(F.col("released_on"), F.col("entity")).alias("message")).filter("message IS NOT NULL")


@query("network_audit", AUDIT + """SELECT k AS row_num, CASE WHEN NOT known THEN 'No reference data found' ELSE 'NETWORK_MISMATCH: not in the reference' END AS message FROM p WHERE m = 7 OR NOT known""")
def network_audit(spark, sf_dir):
    return catalogue(spark, sf_dir).select("row_num", R.network_audit(F.col("network"), F.col("entity")).alias("message")).filter("message IS NOT NULL")


@query("reference_match", """SELECT p_partkey AS row_num, CASE WHEN p_partkey % 5 = 0 THEN 'reference not found' WHEN p_partkey % 7 = 0 THEN 'title differs' ELSE 'type differs' END AS finding FROM part WHERE p_partkey % 2 = 0 AND (p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 3 = 0)""")
def reference_match(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    tt = F.concat(F.lit("tt"), F.lpad(k.cast("string"), 7, "0"))
    rows = part.select(k.alias("row_num"), F.when(k % 2 == 0, F.concat(F.lit("https://www.imdb.com/title/"), tt, F.lit("/"))).otherwise("").alias("imdb_id"), F.col("p_name").alias("title"), F.when(k % 3 == 0, "Movies").otherwise("TV Shows").alias("title_category"))
    titles = part.filter(k % 5 != 0).select(tt.alias("tconst"), F.when(k % 7 == 0, "zzz qqq").otherwise(F.concat(F.lit("The "), "p_name")).alias("primary_title"), F.lit(None).cast("string").alias("original_title"), F.lit("tvSeries").alias("title_type"))
    people = table(spark, sf_dir, "supplier").select(F.concat(F.lit("nm"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")).alias("nconst"), F.col("s_name").alias("primary_name"))
    return R.reference_match(rows, R.reference_records(titles, people), value_col="imdb_id", platform="imdb").filter("finding IS NOT NULL").select("row_num", "finding")


@query("url_audit", """SELECT c_custkey AS row_num, CASE c_custkey % 4 WHEN 0 THEN 'MISSING_WIKIPEDIA: value is missing' WHEN 1 THEN 'FORMAT_ERROR: value has not the form of a reference' ELSE 'WIKIPEDIA_MISMATCH: title does not match' END AS message FROM customer WHERE c_custkey % 4 <> 3""")
def url_audit(spark, sf_dir):
    m = F.col("c_custkey") % 4
    url = F.when(m == 0, " ").when(m == 1, "https://example.com/x").otherwise("https://en.wikipedia.org/wiki/X")
    page = F.when(m == 2, "Someone Else").otherwise(F.concat("c_name", F.lit(" (firm)")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_num"), R.url_audit(url, F.col("c_name"), page, "wikipedia").alias("message")).filter("message IS NOT NULL")


@query("selected_page_check", r"""
WITH q AS (SELECT DISTINCT p_name AS q FROM part), c AS (SELECT q, p_partkey AS k, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' deluxe' ELSE '' END AS t, p_size, p_size % 4 = 0 AS y FROM q JOIN part ON p_name = q),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY y DESC, CASE WHEN t = q THEN 0 ELSE 1 END, p_size DESC, k) AS i FROM c)
SELECT q, k, CASE WHEN t <> q THEN 'title' WHEN NOT y THEN 'year' END AS mismatch FROM r WHERE i = 1""")
def selected_page_check(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    asked = part.select(F.col("p_name").alias("q")).distinct()
    results = asked.join(part, F.col("q") == F.col("p_name")).select("q", k.alias("k"), F.concat("p_name", F.when(k % 3 == 0, " deluxe").otherwise("")).alias("t"), "p_size", F.when(F.col("p_size") % 4 == 0, 2000).otherwise(1999).alias("result_year"))
    named = results.withColumns({"qn": T.norm_title(F.col("q")), "tn": T.norm_title(F.col("t"))})
    best = L.select_result(named, query_id="q", query_norm="qn", title_norm="tn", order=[F.desc("p_size"), F.col("k")], year_match=F.col("result_year") == 2000)
    checked = R.verify_page(best.select("q", "k", F.col("q").alias("query"), F.lit(2000).alias("year"), F.col("t").alias("page_title"), F.lit(None).cast("int").alias("page_year"), "result_year"))
    return checked.select("q", "k", "mismatch")


@query("roster_match", """SELECT DISTINCT lower(c_mktsegment) AS target, lower(c_mktsegment) AS entry, 1.0::DOUBLE AS score FROM customer WHERE lower(c_mktsegment) <> 'machinery'
UNION ALL SELECT 'machinery', 'machinary', 0.889::DOUBLE""")
def roster_match(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"))
    roster = names.distinct().select(F.when(F.upper("name") == "MACHINERY", "Machinary").otherwise(F.lower("name")).alias("name"))
    return R.fuzzy_roster_match(names, roster)


@query("studio_types", """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Major' WHEN 1 THEN 'Independent' ELSE '' END AS studio_type FROM supplier""")
def studio_types(spark, sf_dir):
    m = F.col("s_suppkey") % 3
    names = F.when(m == 0, F.array(F.lit("Pixar"), "s_name")).when(m == 1, F.array("s_name")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.studio_type(names).alias("studio_type"))
