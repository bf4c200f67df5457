"""Queries of comparison and look-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare as C
from ..operators import lookup as L
from .common import table
from .registry import query


def order_versions(spark, sf_dir):
    """Orders, and a second version: some removed, some dearer, some new."""
    k = F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 0).cast("long").alias("price"))
    new = a.filter(k % 101 == 0).withColumn("o_orderkey", k + 1_000_000_000)
    b = a.filter(k % 97 != 0).withColumn("price", F.col("price") + F.when(k % 13 == 0, 1).otherwise(0)).unionByName(new)
    return a, b


VERSIONS = """
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(round(o_totalprice, 0) AS BIGINT) AS price FROM orders),
b AS (SELECT k, s, price + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS price FROM a WHERE k % 97 <> 0 UNION ALL SELECT k + 1000000000, s, price FROM a WHERE k % 101 = 0)
"""


@query("compare_orders", VERSIONS + """SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS row_key, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.price <> b.price OR a.s <> b.s THEN 'modified' ELSE 'unchanged' END AS status,
CASE WHEN a.price <> b.price THEN 'price' END AS "column", CASE WHEN a.price <> b.price THEN CAST(a.price AS VARCHAR) END AS value_a, CASE WHEN a.price <> b.price THEN CAST(b.price AS VARCHAR) END AS value_b
FROM a FULL JOIN b ON a.k = b.k""")
def compare_orders(spark, sf_dir):
    return C.compare(*order_versions(spark, sf_dir), keys=["o_orderkey"])


@query("compare_counts", VERSIONS + """SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.price <> b.price OR a.s <> b.s THEN 'modified' ELSE 'unchanged' END AS status, count(*) AS rows FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def compare_counts(spark, sf_dir):
    return C.compare_counts(C.compare(*order_versions(spark, sf_dir), keys=["o_orderkey"]))


@query("snapshot_delta", VERSIONS + """SELECT CASE WHEN b.k IS NULL THEN 'removed' ELSE 'upsert' END AS change, coalesce(b.k, a.k) AS o_orderkey, b.s AS o_orderstatus, b.price FROM a FULL JOIN b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR a.price IS DISTINCT FROM b.price OR a.s IS DISTINCT FROM b.s""")
def snapshot_delta(spark, sf_dir):
    return C.snapshot_delta(*order_versions(spark, sf_dir), ["o_orderkey"])


@query("upsert_orders", VERSIONS + "SELECT k AS o_orderkey, s AS o_orderstatus, price FROM b UNION ALL SELECT * FROM a WHERE k NOT IN (SELECT k FROM b)")
def upsert_orders(spark, sf_dir):
    return C.upsert(*order_versions(spark, sf_dir), ["o_orderkey"])


@query("pair_diff", """
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS p, o_orderstatus AS s, o_orderkey AS k FROM orders)
SELECT id, 'genre' AS "column", 'changed' AS kind, s || chr(10) || p || 'x' AS ingested, p || chr(10) || s AS "database" FROM o WHERE k % 5 = 0 AND k % 17 <> 0 AND k % 19 <> 0
UNION ALL SELECT id, 'note', 'added', p, '' FROM o WHERE k % 7 = 0 AND k % 17 <> 0 AND k % 19 <> 0
UNION ALL SELECT id, 'title', 'removed', '', s FROM o WHERE k % 11 = 0 AND k % 17 <> 0 AND k % 19 <> 0
UNION ALL SELECT id, NULL, 'missing FROM DB', NULL, NULL FROM o WHERE k % 17 = 0 AND k % 19 <> 0
UNION ALL SELECT id, NULL, 'missing INGESTED', NULL, NULL FROM o WHERE k % 19 = 0 AND k % 17 <> 0""")
def pair_diff(spark, sf_dir):
    k, p, s = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    orders = table(spark, sf_dir, "orders")
    ingested = orders.filter(k % 19 != 0).select(k.alias("brand_id"), F.lit("Ingested").alias("record_type"), F.concat(s, F.lit("\n"), p, F.when(k % 5 == 0, "x").otherwise("")).alias("genre"), F.when(k % 7 == 0, p).otherwise("").alias("note"), F.when(k % 11 == 0, "").otherwise(s).alias("title"))
    database = orders.filter(k % 17 != 0).select(k.alias("brand_id"), F.lit("FROM DB").alias("record_type"), F.concat(p, F.lit("\n"), s).alias("genre"), F.lit("").alias("note"), s.alias("title"))
    return C.pair_diff(ingested.unionByName(database))


@query("url_manager_check", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, page_id % 4 AS m FROM pages)
SELECT page_id, 'facebook' AS platform, CASE WHEN m = 2 THEN '' WHEN m = 1 THEN 'other' ELSE 'https://www.facebook.com/' || h || '/' END AS entry, CASE WHEN m = 3 THEN '' ELSE 'facebook.com/' || h END AS maintained,
CASE m WHEN 0 THEN 'OK' WHEN 1 THEN 'MISMATCH' WHEN 2 THEN 'MISSING' ELSE 'ORPHAN' END AS status FROM p""")
def url_manager_check(spark, sf_dir):
    host, m = F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.col("page_id") % 4
    entry = F.when(m == 1, "Facebook | other | x").when(m != 2, F.concat(F.lit("facebook|gone\nFacebook | https://www.facebook.com/"), host, F.lit("/ | company"))).otherwise("")
    rows = table(spark, sf_dir, "pages").select("page_id", entry.alias("url_managers"), F.when(m == 3, "").otherwise(F.concat(F.lit("facebook.com/"), host)).alias("facebook_page"))
    return C.url_manager_check(rows, ["page_id"])


def part_titles(spark, sf_dir):
    """Parts as a title reference: name as primary, brand as original title."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("tt"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("tconst"), T.norm_lookup(F.col("p_name")).alias("primary_norm"), T.norm_lookup(F.col("p_type")).alias("original_norm"),
        (F.col("p_size") + 1970).alias("start_year"), F.element_at(F.array(*[F.lit(x) for x in ("movie", "tvSeries", "tvEpisode", "short")]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("title_type"),
    )


def title_queries(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("q")).unionByName(table(spark, sf_dir, "part").select(F.col("p_type").alias("q"))).distinct()
    return names.select("q", T.norm_lookup(F.col("q")).alias("norm"), F.when(F.length("q") % 2 == 0, "movie").otherwise("tv").alias("kind"), F.when(F.length("q") % 3 > 0, 1970 + F.length("q")).alias("year"))


TITLES = """
WITH t AS (SELECT 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS tconst, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS pn, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS os, p_size + 1970 AS y,
['movie', 'tvSeries', 'tvEpisode', 'short'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS kind FROM part),
q AS (SELECT q, trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) AS n, CASE WHEN len(q) % 2 = 0 THEN 'movie' ELSE 'tv' END AS want, CASE WHEN len(q) % 3 > 0 THEN 1970 + len(q) END AS wy FROM (SELECT p_name AS q FROM part UNION SELECT p_type FROM part)),
m AS (SELECT q.*, t.*, 'primary_title' AS matched_on FROM q JOIN t ON n = pn WHERE n <> '' UNION ALL SELECT q.*, t.*, 'original_title' FROM q JOIN t ON n = os WHERE n <> '' AND pn <> os)
"""


@query("lookup_title_rank", TITLES + """, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY matched_on DESC, y DESC, tconst) AS match_rank FROM m)
SELECT q, tconst, matched_on, CAST(match_rank AS INTEGER) AS match_rank, count(*) OVER (PARTITION BY q) AS total_matches, CASE WHEN count(*) OVER (PARTITION BY q) = 1 THEN 'matched' ELSE 'multiple_matches' END AS status FROM r WHERE match_rank <= 25""")
def lookup_title_rank(spark, sf_dir):
    found = L.lookup_titles(title_queries(spark, sf_dir), part_titles(spark, sf_dir), query_id="q", query_norm="norm", id_col="tconst", primary_norm="primary_norm", original_norm="original_norm", year_col="start_year")
    return found.select("q", "tconst", "matched_on", "match_rank", "total_matches", "status")


PEOPLE = "WITH c AS (SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) AS b FROM customer), q AS (SELECT n_nationkey AS q, CASE WHEN n_nationkey % 5 = 4 THEN 'nobody' ELSE ['AUTOMOBILE', 'BUILDING', 'MACHINERY', 'HOUSEHOLD'][n_nationkey % 5 + 1] END AS name FROM nation)"


@query("lookup_person_rank", PEOPLE + """, r AS (SELECT q, c_custkey, row_number() OVER (PARTITION BY q ORDER BY b, c_custkey) AS rk FROM q JOIN c ON lower(name) = lower(c_mktsegment))
SELECT q, c_custkey, CAST(rk AS INTEGER) AS match_rank, count(*) OVER (PARTITION BY q) AS total_matches, 'multiple_matches' AS status FROM r WHERE rk <= 25
UNION ALL SELECT q, NULL, NULL, 0, 'not_found' FROM q WHERE name = 'nobody'""")
def lookup_person_rank(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", T.norm_lookup(F.col("c_mktsegment")).alias("norm"), F.round("c_acctbal", 2).alias("b"))
    n = F.col("n_nationkey")
    asked = table(spark, sf_dir, "nation").select(n.alias("q"), F.when(n % 5 == 4, "nobody").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "MACHINERY", "HOUSEHOLD")]), (n % 5 + 1).cast("int"))).alias("name"))
    asked = asked.withColumn("qn", T.norm_lookup(F.col("name")))
    found = L.lookup_people(asked, people, query_id="q", query_norm="qn", id_col="c_custkey", name_norm="norm", order=[F.col("b"), F.col("c_custkey")])
    return found.select("q", "c_custkey", "match_rank", "total_matches", "status")


@query("lookup_auto", """
WITH q AS (SELECT p_name AS q FROM part UNION SELECT s_name FROM supplier),
t AS (SELECT q, CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (PARTITION BY q ORDER BY p_partkey) AS r FROM q JOIN part ON lower(p_name) = lower(q)),
s AS (SELECT q, CAST(s_suppkey AS VARCHAR) AS id, row_number() OVER (PARTITION BY q ORDER BY s_suppkey) AS r FROM q JOIN supplier ON lower(s_name) = lower(q)),
u AS (SELECT 'title' AS kind, * FROM t WHERE r <= 25 UNION ALL SELECT 'person', * FROM s WHERE r <= 25)
SELECT q, id, kind, CAST(row_number() OVER (PARTITION BY q ORDER BY kind DESC, r) AS INTEGER) AS match_rank, count(*) OVER (PARTITION BY q) AS total_matches, CASE WHEN count(*) OVER (PARTITION BY q) > 1 THEN 'multiple_matches' ELSE 'matched' END AS status,
CASE WHEN count(*) OVER (PARTITION BY q) > 1 THEN 'auto:' ELSE '' END || kind || '_to_id' AS resolved_lookup FROM u""")
def lookup_auto(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("o"), T.norm_lookup(F.col("p_name")).alias("norm"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_suppkey").alias("o"), T.norm_lookup(F.col("s_name")).alias("norm"))
    asked = table(spark, sf_dir, "part").select(F.col("p_name").alias("q")).union(table(spark, sf_dir, "supplier").select("s_name")).distinct().withColumn("qn", T.norm_lookup(F.col("q")))
    find = lambda ref: L.lookup_people(asked, ref, query_id="q", query_norm="qn", id_col="id", name_norm="norm", order=[F.col("o")]).select("q", "id", "match_rank", "status")
    return L.merge_auto(find(parts), find(suppliers), "q").select("q", "id", "kind", "match_rank", "total_matches", "status", "resolved_lookup")


@query("known_for", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 3 <> 0)
SELECT l_orderkey, string_agg(n, '; ' ORDER BY l_linenumber, l_partkey) AS names FROM l GROUP BY 1""")
def known_for(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("ids"))
    names = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0")
    return L.resolve_lists(lists, names, row_id="l_orderkey", list_col="ids", id_col="p_partkey", name_col="p_name")


SCORED = TITLES + """, s AS (SELECT q, tconst, matched_on, y, CAST(CASE WHEN matched_on = 'primary_title' THEN 100 + 18 ELSE 92 END + CASE kind WHEN 'movie' THEN 35 WHEN 'tvSeries' THEN 35 WHEN 'tvEpisode' THEN -40 ELSE 8 END
+ CASE WHEN want = 'movie' AND kind = 'movie' THEN 28 WHEN want = 'movie' AND kind = 'tvSeries' THEN -25 WHEN want = 'movie' AND kind = 'tvEpisode' THEN -60 WHEN want = 'tv' AND kind = 'tvSeries' THEN 28 WHEN want = 'tv' AND kind = 'movie' THEN -20 ELSE 0 END
+ CASE WHEN wy IS NULL THEN 4 WHEN wy = y THEN 45 ELSE -least(abs(y - wy) * 3, 24) END AS DOUBLE) AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, y DESC, tconst) AS rk FROM s WHERE score >= 0)
"""


def scored(spark, sf_dir):
    return L.scored_title_matches(title_queries(spark, sf_dir), part_titles(spark, sf_dir), query_id="q", query_norm="norm", want_kind="kind", want_year="year", id_col="tconst", primary_norm="primary_norm", original_norm="original_norm", kind_col="title_type", year_col="start_year")


@query("scored_title_match", SCORED + "SELECT q, tconst, matched_on, score, CAST(rk AS INTEGER) AS match_rank FROM r WHERE rk <= 10")
def scored_title_match(spark, sf_dir):
    return scored(spark, sf_dir)


@query("match_status", SCORED + """, b AS (SELECT q, max(score) FILTER (WHERE rk = 1) AS a, max(score) FILTER (WHERE rk = 2) AS n FROM r GROUP BY q)
SELECT q, a AS score, CASE WHEN a >= 150 AND (n IS NULL OR a - n >= 8) THEN 'found' WHEN a >= 110 THEN 'uncertain' ELSE 'not_found' END AS status FROM b""")
def match_status(spark, sf_dir):
    return L.match_status(scored(spark, sf_dir), "q")


@query("episode_counts", """
WITH e AS (SELECT l_orderkey AS parent, CASE WHEN l_linenumber - 2 > 0 THEN l_linenumber - 2 END AS s, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT parent, count(s) AS season_count, max(s) AS latest_season_number, max_by(n, s) FILTER (WHERE s IS NOT NULL) AS latest_season_episode_count, CAST(sum(n) AS BIGINT) AS episode_count FROM e GROUP BY parent""")
def episode_counts(spark, sf_dir):
    return L.episode_counts(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 2).alias("season")), parent="l_orderkey", season="season")


@query("season_windows", """
WITH l AS (SELECT l_orderkey, l_linenumber % 3 AS s, CAST(l_shipdate AS DATE) AS d FROM lineitem), m AS (SELECT *, max(s) OVER (PARTITION BY l_orderkey) AS x FROM l),
g AS (SELECT l_orderkey, min(d) AS a, max(d) AS z, count(d) AS n FROM m WHERE s = x GROUP BY 1)
SELECT l_orderkey, a AS start_date, CASE WHEN n <= 1 OR a = z THEN a + 30 ELSE z END AS end_date, n AS episodes FROM g""")
def season_windows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("s"), F.to_date("l_shipdate").alias("d"))
    return L.season_windows(lines, parent="l_orderkey", season="s", date="d")


@query("release_type", """
WITH o AS (SELECT o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS t, CAST(o_orderdate AS DATE) AS d FROM orders),
p AS (SELECT *, list_position([3, 2, 4, 6, 5, 1], t) AS r, list_position([3, 2, 1, 4, 5, 6], t) AS dr FROM o)
SELECT o_custkey, ['Wide', 'Limited', 'Digital', 'TV', 'Physical', 'Premiere'][min(r)] AS release_type, first(d ORDER BY dr, d) AS release_date FROM p GROUP BY 1""")
def release_type(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.substring("o_orderpriority", 1, 1).cast("int") + F.when(F.col("o_orderkey") % 6 == 0, 1).otherwise(0)).alias("t"), F.to_date("o_orderdate").alias("d"))
    return L.release_labels(orders, key="o_custkey", type_col="t", date_col="d")


@query("verify_metadata", """
SELECT p_partkey AS k, f AS field, s AS severity FROM part, (VALUES ('id', 'high', 11), ('title', 'high', 5), ('year', 'medium', 7), ('network', 'medium', 13), ('genres', 'low', 3)) v(f, s, m)
WHERE CASE WHEN f = 'id' THEN p_partkey % 11 = 0 ELSE p_partkey % m = 0 AND p_partkey % 11 <> 0 END""")
def verify_metadata(spark, sf_dir):
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    actual = parts.filter(k % 11 != 0).select(k.alias("k"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.col("p_brand").alias("network"), F.array(F.lit("Sci-Fi"), "p_type").alias("genres"))
    claims = parts.select(
        k.alias("k"), F.concat("p_name", F.when(k % 5 == 0, " two").otherwise("!")).alias("title"), (F.col("p_size") + F.when(k % 7 == 0, 1).otherwise(0)).alias("year"),
        F.when(k % 13 == 0, "nothing").otherwise(F.concat(F.lit("The "), "p_brand")).alias("network"), F.when(k % 3 == 0, F.array(F.lit("none"))).otherwise(F.array(F.lit("scifi"))).alias("genres"),
    )
    return L.verify_metadata(claims, actual, "k")


@query("assemble_metadata", """
WITH a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_name END AS title, p_brand AS network FROM part WHERE p_partkey % 5 <> 0),
b AS (SELECT s_suppkey AS k, s_name AS title, 'S' AS network FROM supplier)
SELECT k, CASE WHEN trim(coalesce(a.title, '')) <> '' THEN a.title ELSE b.title END AS title, coalesce(a.network, b.network) AS network FROM a FULL JOIN b USING (k)""")
def assemble_metadata(spark, sf_dir):
    k = F.col("p_partkey")
    a = table(spark, sf_dir, "part").filter(k % 5 != 0).select(k.alias("k"), F.when(k % 4 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("network"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("title"), F.lit("S").alias("network"))
    return L.assemble(a, b, "k", ["title", "network"])


@query("validate_reference_match", """SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'not found' ELSE 'title mismatch' END AS finding FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 50 <> 0
WHERE p_partkey IS NULL OR NOT (contains(lower(p_name), 'e') OR l_linenumber % 2 = 0)""")
def validate_reference_match(spark, sf_dir):
    claimed = F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")).otherwise("E")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").filter("p_partkey % 50 <> 0"), F.col("l_partkey") == F.col("p_partkey"), "left")
    finding = F.when(F.col("p_partkey").isNull(), "not found").when(~T.loosely_equal(T.norm_title(claimed), T.norm_title(F.col("p_name"))), "title mismatch")
    return lines.select("l_orderkey", "l_linenumber", finding.alias("finding")).filter("finding IS NOT NULL")


@query("lookup_status_counts", PEOPLE + "SELECT CASE WHEN name = 'nobody' THEN 'not_found' ELSE 'multiple_matches' END AS status, count(*) AS queries FROM q GROUP BY 1")
def lookup_status_counts(spark, sf_dir):
    return L.status_counts(lookup_person_rank(spark, sf_dir), "q")
