"""Queries of downloads, reference addresses, bulk classification, charts, programmes and pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes as C
from ..operators import exports as E
from ..operators import extract as X
from ..operators import lookup as L
from ..operators import pipelines as W
from ..operators import references as R
from ..operators import rule_pack
from ..operators import rules
from ..operators import tickets as K
from .common import table, with_checkpoints
from .registry import query


@query("export_site_rows", """
WITH h AS (SELECT o_custkey AS k, o_orderpriority AS site, o_orderkey AS rank, 'https://shop.example/' || o_orderkey AS url FROM orders),
s AS (SELECT k, site, list(url ORDER BY rank) AS u, min(rank) AS r FROM h GROUP BY 1, 2)
SELECT k AS query_id, c_name AS input_title, c_nationkey AS input_year, c_mktsegment AS input_type, site, CASE WHEN len(u) > 1 THEN 'multiple' ELSE 'found' END AS status, u[1] AS url, 'Order ' || r AS matched_title,
CAST(r % 100 AS DOUBLE) AS score, array_to_string(u[2:], ' | ') AS alternates, c_mktsegment || ' | ' || site AS notes FROM s JOIN customer ON c_custkey = k""")
def export_site_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("site"), k.alias("rank"), F.concat(F.lit("https://shop.example/"), k).alias("url"), F.concat(F.lit("Order "), k).alias("result_title"), (k % 100).cast("double").alias("score"))
    several = orders.groupBy("query_id", "site").agg(F.when(F.count("*") > 1, "multiple").otherwise("found").alias("status"))
    hits = orders.join(several, ["query_id", "site"]).withColumn("notes", F.array("site"))
    queries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("year"), F.col("c_mktsegment").alias("title_type"), F.array("c_mktsegment").alias("notes"))
    return E.export_site_rows(queries, hits)


@query("export_chart", """SELECT CAST(s_suppkey AS VARCHAR) AS "Rank", s_name AS "Name", '' AS "Last Week", CAST(s_nationkey AS VARCHAR) AS "Peak", '' AS "Weeks", '' AS "In Roster", '' AS "Roster Match", '' AS "Score" FROM supplier""")
def export_chart(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rank"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("peak_position"), F.lit(None).cast("string").alias("last_week"))
    return E.export_table(rows, "chart")


@query("reference_urls", """
SELECT c_custkey, 'https://www.facebook.com/c' || c_custkey AS facebook, 'https://x.com/c' || c_custkey AS twitter, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'https://www.instagram.com/c.' || c_custkey || '/' END AS instagram,
'https://www.youtube.com/@c' || c_custkey AS youtube, 'https://www.tiktok.com/@c' || c_custkey AS tiktok, 'https://en.wikipedia.org/wiki/Caf%C3%A9_' || c_custkey || '/x' AS wikipedia, 'https://www.wikidata.org/wiki/Q' || c_custkey AS wikidata,
CASE c_custkey % 3 WHEN 0 THEN 'https://www.imdb.com/title/tt' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || '/' WHEN 1 THEN 'https://www.imdb.com/name/nm' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || '/' ELSE NULL END AS imdb FROM customer""")
def reference_urls(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    odd, mod = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3
    ids = F.when(mod == 0, F.concat(F.lit("tt"), F.lpad(k, 7, "0"))).when(mod == 1, F.concat(F.lit("nm"), F.lpad(k, 7, "0"))).otherwise(F.concat(F.lit("co"), k))
    given = {
        "facebook": F.concat(F.when(odd, "@").otherwise("https://www.facebook.com/"), F.lit("c"), k), "twitter": F.concat(F.lit(" @c"), k), "instagram": F.concat(F.lit("c."), k, F.when(mod == 0, " x").otherwise("")),
        "youtube": F.concat(F.when(odd, "@").otherwise(""), F.lit("c"), k), "tiktok": F.concat(F.lit("@c"), k, F.lit("/")), "wikipedia": F.concat(F.lit("Café "), k, F.lit("/x")), "wikidata": F.concat(F.lit("q"), k), "imdb": ids,
    }
    return table(spark, sf_dir, "customer").select("c_custkey", *[T.reference_url(p, v).alias(p) for p, v in given.items()])


@query("classify_bulk", """
WITH s AS (SELECT *, s_suppkey % 5 AS m FROM supplier)
SELECT CASE WHEN m = 4 THEN ' ' ELSE upper(s_name) END AS "Title", CASE WHEN m = 0 THEN 'https://www.instagram.com/S' || s_suppkey || '/' WHEN m = 1 THEN '@s' || s_suppkey ELSE NULL END AS "Instagram", s_suppkey,
CASE WHEN m = 4 THEN 'UNVERIFIED' WHEN m < 2 THEN 'Talent' WHEN m = 2 THEN 'Retail' ELSE 'UNVERIFIED' END AS title_category,
CASE WHEN m = 4 THEN 'Title name cannot be blank.' WHEN m < 2 THEN 'Gender - Woman' WHEN m = 2 THEN 'Stores' ELSE '' END AS title_sub_category FROM s""")
def classify_bulk(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    m = k % 5
    rows = s.select(F.when(m == 4, " ").otherwise(F.upper("s_name")).alias("Title"), F.when(m == 0, F.concat(F.lit("https://www.instagram.com/S"), k, F.lit("/"))).when(m == 1, F.concat(F.lit("@s"), k)).alias("Instagram"), "s_suppkey")
    profiles = s.filter(m < 2).select(F.concat(F.lit("s"), k).alias("handle"), F.lit("Talent").alias("category"), F.lit("Gender - Woman").alias("sub_category"))
    references = s.filter(m < 3).select(F.lower("s_name").alias("title"), F.lit("Retail").alias("category"), F.lit("Stores").alias("sub_category"))
    return K.classify_bulk(rows, profiles, references)


@query("chart_new_entries", """
WITH s AS (SELECT s_suppkey, lower(s_name) AS n, s_name FROM supplier WHERE s_suppkey % 3 = 0)
SELECT s_suppkey AS rank, CASE s_suppkey % 2 WHEN 0 THEN s_name ELSE 'Wholly other ' || s_suppkey END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'roster' ELSE NULL END AS gender, s_suppkey % 2 = 0 AS in_roster,
CASE WHEN s_suppkey % 2 = 0 THEN n ELSE '' END AS roster_match, CASE WHEN s_suppkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM s""")
def chart_new_entries(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    chart = s.select(k.alias("rank"), F.when(k % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("Wholly other "), k)).alias("name"), F.when(k % 3 == 0, "-").otherwise(k.cast("string")).alias("last_week"))
    roster = s.select(F.lower("s_name").alias("name"), F.lit("roster").alias("gender"))
    return R.chart_new_entries(chart, roster, fill=("gender",)).drop("last_week")


@query("tv_programmes", """
WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d, o_custkey AS c FROM orders)
SELECT CAST(k AS VARCHAR) AS page_id, strftime(d, '%Y-%m-%d') AS release_date, 'Show ' || k AS title, 'https://www.metacritic.com/tv/show-' || k AS url, CASE WHEN k % 2 = 0 THEN 'NBC' ELSE 'Hulu; PBS' END AS network,
CASE WHEN k % 2 = 0 THEN 'Daypart - Prime Time (8:00pm-11:00pm (M-Sat) / 7:00pm-11:00pm (Sun))' ELSE 'Daypart - Other' END AS daypart,
CASE k % 3 WHEN 0 THEN 'Program Type - Series' WHEN 1 THEN 'Program Type - Mini-Series' ELSE 'Program Type - Other' END AS program_type, CASE WHEN k % 5 = 0 THEN 'Language Type - Other' ELSE 'Language Type - English' END AS language_type,
'Action' AS genre_1, 'Adventure' AS genre_2, 'Sci Fi' AS genre_3 FROM o""")
def tv_programmes(spark, sf_dir):
    k = F.col("o_orderkey")
    mark = F.when(k % 3 == 0, '<img alt="New Series">').when(k % 3 == 1, '<img src=x alt="Limited Series">').otherwise("")
    genres = F.concat(F.when(k % 5 == 0, "Foreign/").otherwise(""), F.lit("Action-Adventure/Sci-Fi/Drama: A show about it."))
    networks = F.when(k % 2 == 0, "NBC 8:30p ET").otherwise("Streaming (Hulu)<br>PBS 2p<br>TBD")
    body = F.concat(
        F.lit("<h2>Calendar for "), F.year("o_orderdate"), F.lit("</h2><h3>"), F.date_format("o_orderdate", "EEEE, MMMM d, yyyy"), F.lit("</h3><table><tr><td>61</td><td>"), mark, F.lit('<strong><a href="/tv/show-'), k, F.lit('">Show '), k,
        F.lit("</a></strong><br>"), genres, F.lit("</td><td>"), networks, F.lit("</td></tr></table>"),
    )
    pages = table(spark, sf_dir, "orders").select(k.cast("string").alias("page_id"), body.alias("body"), F.lit(2000).alias("base_year"))
    return X.tv_classification(pages).drop("pos")


@query("change_attributes", r"""
SELECT s_suppkey AS seq, 'Şahin Łuk Ōba ' || s_suppkey || ' - DAR' AS title, 'Talent' AS title_category, 'Gender - Woman' || chr(10) || 'Talent Type - Singer' || chr(10) || 'Talent Type - Film Actor' AS title_sub_category,
's.' || s_suppkey AS instagram_user, '#s' || s_suppkey || '|DAR|DAR' AS twitter_search_terms, CASE WHEN s_suppkey % 2 = 0 THEN 'NOT FOUND: imdb_id|NOT FOUND: wikipedia_page' ELSE 'NOT FOUND: wikipedia_page' END AS flags FROM supplier""")
def change_attributes(spark, sf_dir):
    k = F.col("s_suppkey")
    line = F.concat(F.lit("NEW | Şahin Łuk Ōba "), k, F.lit(" | Talent | Instagram=@s."), k, F.lit("; Gender = woman;TYPE=singer, film actor"), F.when(k % 2 == 1, F.concat(F.lit(";IMDB=nm"), F.lpad(k.cast("string"), 7, "0"))).otherwise(""))
    lines = table(spark, sf_dir, "supplier").select(k.alias("seq"), line.alias("line"))
    rows = C.new_rows(C.parse_change_list(lines), today="2024-01-01", companies="Own", brand_set="Own Brands")
    return rows.select("seq", "title", "title_category", "title_sub_category", "instagram_user", "twitter_search_terms", F.array_join("flags", "|").alias("flags"))


@query("folded_titles", "SELECT s_suppkey, '#sahinukoba' || s_suppkey || 'cech|DAR|DAR' AS terms FROM supplier")
def folded_titles(spark, sf_dir):
    title = F.concat(F.lit("Şahin Łuk Ōba "), F.col("s_suppkey"), F.lit(" Čech - DAR"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.search_terms(F.lit(None).cast("string"), F.lit(""), title).alias("terms"))


@query("bulk_enrich", r"""
WITH p AS (SELECT p_partkey AS k, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS n, p_size + 1970 AS y FROM part),
m AS (SELECT a.k, b.k AS id, b.y, CASE WHEN a.y = b.y THEN 45 ELSE -least(abs(a.y - b.y) * 3, 24) END AS s FROM p a JOIN p b ON a.n = b.n),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, y DESC, id) AS i FROM m),
t AS (SELECT k, min(id) FILTER (WHERE i = 1) AS id, count(*) AS n, max(s) AS hi, min(s) AS lo FROM r WHERE i <= 2 GROUP BY k)
SELECT t.k AS row_id, t.id AS enriched_id, p.y AS enriched_start_year, CASE WHEN t.n > 1 AND hi = lo THEN 'multiple' ELSE 'matched' END AS enrich_status FROM t JOIN p ON p.k = t.id
UNION ALL SELECT -1 - s_suppkey, NULL, NULL, 'not_found' FROM supplier""")
def bulk_enrich(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.norm_lookup(F.col("p_name")).alias("n"), F.lit(None).cast("string").alias("o"), F.lit("movie").alias("kind"), (F.col("p_size") + 1970).alias("start_year"), "p_name")
    rows = part.select(F.col("id").cast("long").alias("row_id"), F.col("p_name").alias("title"), F.concat(F.lit("in "), "start_year").alias("released"), F.lit("Movies").alias("category"))
    rows = rows.unionByName(table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).cast("long").alias("row_id"), F.concat(F.lit("no such "), "s_suppkey").alias("title"), F.lit(None).cast("string").alias("released"), F.lit("TV Shows").alias("category")))
    got = L.bulk_enrich(rows, part.drop("p_name"), row_col="row_id", title="title", year="released", category="category", id_col="id", primary_norm="n", original_norm="o", kind_col="kind", year_col="start_year", carry={"start_year": "start_year"})
    return got.select("row_id", "enriched_id", "enriched_start_year", "enrich_status")


PACK = rules.parse_rules(rule_pack.default_rules(companies=["Own A", "Own B", "Own C"], tv_companies=["Own A", "Own TV"], own_set="Own Brands", view_set="View", wide_set="Wide", film_set="Film"))


@query("default_rules", r"""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS m FROM orders),
f AS (SELECT k AS row_num, 'title' AS "column", 'Title cannot be blank, #NA, or N/A.' AS message FROM o WHERE m = 1
UNION ALL SELECT k, 'title_category', 'Title category is blank or not in the approved list.' FROM o WHERE m = 2
UNION ALL SELECT k, 'genre', 'Genre is required for Movies and TV Shows.' FROM o WHERE m IN (1, 3)
UNION ALL SELECT k, 'network', 'Network cannot be blank for Movies and TV Shows.' FROM o WHERE m = 1
UNION ALL SELECT k, 'twitter_search_term_keywords', 'twitter_search_term_keywords cannot contain #VALUE!.' FROM o WHERE m = 2
UNION ALL SELECT k, 'brand_set', 'DAR titles must include Own Brands in brand_set.' FROM o WHERE m = 3
UNION ALL SELECT k, 'brand_set', 'Non-DAR titles must include View in brand_set.' FROM o WHERE m IN (1, 2)
UNION ALL SELECT k, 'companies', 'Companies cannot be blank for non-DAR titles.' FROM o WHERE m = 2
UNION ALL SELECT k, 'companies', 'DAR titles must include Own A, Own B, or Own C in companies.' FROM o WHERE m = 3)
SELECT *, CASE WHEN contains(message, 'is required') THEN 'Needs Manual Review' ELSE 'Suspected Incorrect' END AS finding_category,
CASE WHEN contains(message, 'cannot contain') THEN 'The URL format contains path segments reserved for personal timelines or page setup templates.' WHEN contains(message, 'is required') THEN 'Field is required according to rules but is currently blank.'
WHEN contains(message, 'approved list') THEN 'Cell value is not in the list of approved classification tags.' ELSE '' END AS confidence_reason FROM f""")
def default_rules(spark, sf_dir):
    m = F.col("o_orderkey") % 4
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_num"), F.when(m == 0, F.concat(F.lit("A"), "o_orderkey")).when(m == 1, "#na").when(m == 2, "B").otherwise("Own film - DAR").alias("title"),
        F.when(m == 0, "Talent").when(m == 2, "Nothing known").otherwise("Movies").alias("title_category"), F.when(m == 0, "Drama").otherwise("").alias("genre"), F.when(m == 0, " view ").otherwise("Other").alias("brand_set"),
        F.when(m == 1, " ").otherwise("Net").alias("network"), F.when(m == 2, "#VALUE!").otherwise("word").alias("twitter_search_term_keywords"), F.when(m == 2, "n/a").otherwise("Some").alias("companies"),
    )
    found = rules.validate(rows, PACK, sheet="titles")
    return found.select("row_num", "column", "message", rules.finding(F.col("message")).alias("f")).select("row_num", "column", "message", "f.finding_category", "f.confidence_reason")


@query("full_qa_counts", """
WITH n AS (SELECT lower(trim(c_mktsegment)) AS s, count(*) AS n FROM customer GROUP BY 1)
SELECT 'issues' AS part, count(*) AS n FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT 'exact', sum(n) FROM n WHERE n > 1 UNION ALL SELECT 'fuzzy', sum(n) FROM n WHERE n > 1 UNION ALL SELECT 'health', 1""")
def full_qa_counts(spark, sf_dir):
    with_checkpoints(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_num"), F.when(F.col("c_custkey") % 2 == 0, F.lit("x")).otherwise("").alias("note"), "c_mktsegment")
    found = W.full_qa(rows, rules.parse_rules([{"column": "note", "check": "required"}]), title="c_mktsegment", keys=["c_mktsegment"], row_col="row_num")
    counts = [found[p].agg(F.lit(p).alias("part"), F.count("*").alias("n")) for p in ("issues", "exact", "fuzzy", "health")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("review_hits", """
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 6 AS m FROM supplier)
SELECT k, CASE WHEN m IN (0, 1, 4) THEN 'https://x.com/a' ELSE '' END AS twitter_url, CASE m WHEN 2 THEN 'Too common | Dropped weak twitter candidate: big lake | No confident official profile found.' WHEN 3 THEN 'Dropped weak twitter candidate: 12345 | No confident official profile found.'
WHEN 5 THEN 'No confident official profile found.' ELSE '' END AS review_notes FROM s""")
def review_hits(spark, sf_dir):
    k = F.col("s_suppkey")
    m = k % 6
    title = F.when(m == 2, "Common").otherwise(F.concat(F.lit("Big Lake "), k))
    handle = F.when(m == 0, "biglakeshow").when(m == 1, "Listed").when(m == 2, "big lake").when(m == 3, "12345").otherwise("someone")
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("k"), title.alias("title"), F.when(m == 5, "").otherwise("https://x.com/a").alias("twitter_url"), handle.alias("twitter_handle"), F.when(m == 0, "High").otherwise("Low").alias("twitter_confidence"),
        F.when(m == 4, "Google knowledge graph").otherwise("web").alias("twitter_source"), F.lit("").alias("twitter_evidence"),
    )
    allow = table(spark, sf_dir, "supplier").filter(m == 1).select(title.alias("title"), F.lit("twitter").alias("platform"), F.lit("@listed").alias("handle"))
    ambiguous = spark.createDataFrame([("Common", "Too common")], "title string, note string")
    return K.review_hits(rows, key="k", title="title", platforms=["twitter"], allow=allow, ambiguous=ambiguous, invalid=spark.createDataFrame([("nobody",)], "handle string")).select("k", "twitter_url", "review_notes")
