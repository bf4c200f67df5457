"""Queries of metadata records; the line items stand for releases, names and videos of the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import metadata as M
from ..operators import scoring as S
from .common import table
from .registry import query

# of lines with one place the one with the least supplier and price counts
LINES = """l AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS pos, min(struct_pack(s := l_suppkey, p := l_extendedprice, q := l_quantity, f := l_returnflag, st := l_linestatus, d := l_discount,
    n := l_linenumber, day := strftime(l_shipdate, '%Y-%m-%d'))) AS r FROM lineitem GROUP BY ALL)"""


def lines(spark, sf_dir):
    fields = F.struct(F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("st"), F.col("l_discount").alias("d"), F.col("l_linenumber").alias("n"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    placed = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), fields.alias("r"))
    return placed.groupBy("id", "pos").agg(F.min("r").alias("r"))


def releases(rows):
    return rows.select("id", "pos", F.when(F.col("r.n") % 2 == 1, "us").otherwise("GB").alias("country"), F.col("r.n").alias("type"), F.when(F.col("r.q") < 5, "soon").otherwise(F.concat("r.day", F.lit("T00:00"))).alias("date"))


def names(rows):
    kind = F.when(F.col("r.f") == "A", "genre").when(F.col("r.f") == "N", "company").otherwise("network")
    return rows.select("id", "pos", kind.alias("kind"), F.when(F.col("r.q") == 7, " ").otherwise(F.concat(F.lit("n"), "r.s")).alias("name"))


NAMES = """n AS (SELECT id, string_agg('n' || r.s, '|' ORDER BY pos) FILTER (WHERE r.f = 'A') AS genres, string_agg('n' || r.s, '|' ORDER BY pos) FILTER (WHERE r.f = 'N') AS companies,
    string_agg('n' || r.s, '|' ORDER BY pos) FILTER (WHERE r.f NOT IN ('A', 'N')) AS networks FROM l WHERE r.q <> 7 GROUP BY id)"""


@query("movie_reference", rf"""
WITH {LINES}, {NAMES},
u AS (SELECT id, min(list_position([3, 2, 4, 6, 5, 1], r.n)) AS t, first(r.day ORDER BY coalesce(list_position([3, 2, 1, 4, 5, 6], r.n), 9), r.day) FILTER (WHERE r.q >= 5) AS us FROM l WHERE r.n % 2 = 1 GROUP BY id),
d AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS tv, CASE WHEN p_partkey % 7 = 0 THEN 'Original ' || p_partkey ELSE p_name END AS title, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE (1970 + p_size) || '-01-02' END AS day FROM part),
j AS (SELECT d.*, CASE WHEN tv THEN NULL ELSE us END AS us_date, t, genres, companies, networks FROM d LEFT JOIN u USING (id) LEFT JOIN n USING (id))
SELECT id, CASE WHEN tv THEN 'tvSeries' ELSE 'movie' END AS type, title, us_date, coalesce(us_date, day) AS release_date, CASE WHEN us_date IS NOT NULL THEN 'US' WHEN day IS NOT NULL THEN 'global' ELSE '' END AS release_date_source,
CASE WHEN tv THEN '' ELSE coalesce(['Wide', 'Limited', 'Digital', 'TV', 'Physical', 'Premiere'][t], '') END AS release_type, coalesce(genres, '') AS genres, CASE WHEN tv THEN '' ELSE coalesce(companies, '') END AS companies,
CASE WHEN tv THEN coalesce(networks, '') ELSE '' END AS networks, coalesce(CAST(substr(coalesce(us_date, day), 1, 4) AS INTEGER), 0) AS year FROM j""")
def movie_reference(spark, sf_dir):
    k = F.col("p_partkey")
    day = F.when(k % 5 == 0, None).when(k % 5 == 1, "some day").otherwise(F.concat((F.col("p_size") + 1970).cast("string"), F.lit("-01-02T10:00")))
    details = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 == 0, "tv").otherwise("movie").alias("kind"), F.when(k % 7 != 0, F.col("p_name")).alias("title"), F.concat(F.lit("Original "), k).alias("original_title"), day.alias("release_date"))
    rows = lines(spark, sf_dir)
    made = M.movie_reference(details, releases(rows), names(rows))
    return made.select("id", "type", "title", "us_date", "release_date", "release_date_source", "release_type", *[F.array_join(c, "|").alias(c) for c in ("genres", "companies", "networks")], "year")


@query("unified_metadata", rf"""
WITH {LINES}, {NAMES},
w AS (SELECT id, last(CASE WHEN r.q < 5 THEN 'soon' ELSE r.day END ORDER BY pos) FILTER (WHERE r.n = 3) AS theatrical FROM l GROUP BY id),
v AS (SELECT *, r.d > 0.05 AS official FROM l WHERE r.f = 'A' AND r.st = 'O'),
o AS (SELECT id, min(pos) FILTER (WHERE official) AS first_official, max(pos) AS latest FROM v GROUP BY id),
t AS (SELECT v.id, 'https://www.youtube.com/watch?v=v' || v.pos AS url, v.r.day AS day FROM v JOIN o ON v.id = o.id AND v.pos = coalesce(o.first_official, o.latest)),
p AS (SELECT p_partkey AS id, p_name AS title, p_size AS runtime, p_partkey % 4 AS m FROM part),
s AS (SELECT s_suppkey * 3 AS id, s_name AS title FROM supplier),
j AS (SELECT coalesce(p.id, s.id) AS id, p.id IS NOT NULL AS own, p.title AS pt, s.title AS st, runtime, m, s.id IS NOT NULL AS other FROM p FULL JOIN s ON p.id = s.id)
SELECT j.id, CASE WHEN own AND m <> 1 THEN pt ELSE coalesce(st, '') END AS title, CASE WHEN coalesce(m = 2, FALSE) OR other THEN 'movie' ELSE 'tvSeries' END AS title_type, CASE WHEN m IN (0, 2) THEN '2001' WHEN m IN (1, 3) THEN '1999' ELSE '1888' END AS year,
CASE WHEN own AND m <> 3 AND runtime <> 0 THEN CAST(runtime AS VARCHAR) WHEN own AND m = 3 THEN '33' WHEN other THEN '90 min' ELSE '' END AS runtime_minutes,
CASE WHEN own AND n.genres IS NOT NULL THEN n.genres WHEN other THEN 'Drama|War' ELSE '' END AS genres, CASE WHEN own THEN coalesce(replace(n.networks, '|', ', '), '') ELSE '' END AS networks,
CASE WHEN own AND w.theatrical IS NOT NULL THEN w.theatrical WHEN m IN (0, 2) THEN '2001-02-03' ELSE '' END AS theatrical_release_date, CASE WHEN own THEN coalesce(t.url, '') ELSE '' END AS trailer_url, CASE WHEN own THEN coalesce(t.day, '') ELSE '' END AS trailer_release_date
FROM j LEFT JOIN n ON n.id = j.id LEFT JOIN w ON w.id = j.id LEFT JOIN t ON t.id = j.id""")
def unified_metadata(spark, sf_dir):
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    m = k % 4
    primary = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(m == 2, "movie").alias("media_type"), F.when(m != 1, F.col("p_name")).otherwise("").alias("title"), none.alias("original_title"), F.when(m.isin(0, 2), "2001-02-03").alias("release_date"), F.when(m.isin(1, 3), "1999-01-01").alias("first_air_date"),
        none.alias("last_air_date"), F.when(m != 3, F.col("p_size")).alias("runtime"), F.when(m == 3, F.array(F.lit(33), F.lit(44))).alias("episode_run_time"), F.lit(0.0).alias("vote_average"), F.lit(5).alias("vote_count"), none.alias("overview"), none.alias("poster_path"), none.alias("status"),
    )
    secondary = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("title"), F.lit("movie").alias("type"), F.lit("1888").alias("year"), F.lit("90 min").alias("runtime"), F.lit("7.1").alias("rating"), F.lit("9").alias("votes"), F.lit("Plot").alias("plot"), none.alias("poster"),
        F.lit("Drama, War,").alias("genre"), none.alias("director"), none.alias("writer"), none.alias("actors"),
    )
    rows = lines(spark, sf_dir)
    videos = rows.select("id", "pos", F.when(F.col("r.f") == "A", "Trailer").otherwise("Teaser").alias("type"), F.when(F.col("r.st") == "O", "YouTube").otherwise("Other").alias("site"), F.concat(F.lit("v"), "pos").alias("video"), (F.col("r.d") > 0.05).alias("official"), F.col("r.day").alias("published_at"))
    dated = releases(rows).withColumn("date", F.when(F.col("date") != "soon", F.col("date")).otherwise("soon"))
    made = M.assemble_metadata(primary, secondary, releases=dated, videos=videos, names=names(rows))
    return made.select("id", "title", "title_type", "year", "runtime_minutes", F.array_join("genres", "|").alias("genres"), "networks", "theatrical_release_date", "trailer_url", "trailer_release_date")


@query("links_from_claims", """
WITH c AS (SELECT c_custkey AS k, c_name AS n, replace(c_name, '#', '') AS h FROM customer),
l AS (SELECT k, 'facebook' AS platform, 'https://facebook.com/' || h AS url, h AS handle, 'Username from Wikidata' AS evidence FROM c WHERE k % 2 = 0
UNION ALL SELECT k, 'tiktok', 'https://tiktok.com/@' || h, '@' || h, 'Username from Wikidata' FROM c WHERE k % 3 = 0
UNION ALL SELECT k, 'imdb', 'https://imdb.com/' || CASE WHEN k % 2 = 0 THEN 'title/tt' ELSE 'name/nm' END || k, CASE WHEN k % 2 = 0 THEN 'tt' ELSE 'nm' END || k, 'IMDb id from Wikidata' FROM c WHERE k % 5 <> 0
UNION ALL SELECT k, 'wikipedia', 'https://en.wikipedia.org/wiki/' || h, 'wiki', 'Canonical Wikipedia page' FROM c WHERE k % 7 = 0)
SELECT k, platform, url, handle, evidence, CASE WHEN k % 4 = 0 THEN 'https://' || k || '.example.org' END AS official_website FROM l""")
def links_from_claims(spark, sf_dir):
    k, account = F.col("c_custkey"), F.replace("c_name", F.lit("#"), F.lit(""))
    value = lambda v, kind="string": F.struct(F.struct(F.struct(F.lit(kind).alias("type"), v.alias("value")).alias("datavalue")).alias("mainsnak"))
    # an item's id stands before the text value, which is the one that counts
    held = lambda test, v: F.when(test, F.array(value(F.lit('{"id": "Q1"}'), "wikibase-entityid"), value(v), value(F.lit("later"))))
    claims = F.struct(
        held(k % 2 == 0, account).alias("P2013"), held(k % 3 == 0, F.concat(F.lit("@"), account)).alias("P7085"), held(k % 5 != 0, F.concat(F.when(k % 2 == 0, "tt").otherwise("nm"), k)).alias("P345"),
        held(k % 4 == 0, F.concat(F.lit("https://"), k, F.lit(".example.org"))).alias("P856"), held(k > 0, F.lit("x")).alias("P31"),
    )
    items = table(spark, sf_dir, "customer").select(k.alias("k"), F.to_json(claims).alias("claims"), F.when(k % 7 == 0, F.concat(F.lit("https://EN.wikipedia.org/wiki/"), account, F.lit("?a=b"))).alias("page"))
    return S.links_from_claims(items, key="k", page_url="page")


# of three results the second has no address of a page; the last one's snippet is too far away where the key is even
@query("search_snippets", """
WITH p AS (SELECT p_partkey AS k, p_name AS n FROM part)
SELECT k AS page_id, 1 AS position, n || ' & more' AS title, 'https://site' || k % 10 || '.org/a b' AS url, 'About ' || n AS snippet, 'site' || k % 10 || '.org' AS source_domain FROM p
UNION ALL SELECT k, 3, 'Last', 'http://Last.org/?q=' || k, CASE WHEN k % 2 = 0 THEN '' ELSE 'Near' END, 'last.org' FROM p""")
def search_snippets(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    html = F.concat(
        F.lit('<a rel=x class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fsite'), k % 10, F.lit('.org%2Fa%20b&amp;rut=1"><b>'), name, F.lit('</b> &amp; more</a> <a class="result__snippet" href="y">About  <i>'), name,
        F.lit('</i></a><a class="result__a" href="/local">Local</a><a class="result__a" href="http://Last.org/?q='), k, F.lit('">Last</a>'), F.when(k % 2 == 0, F.repeat(F.lit("."), 2100)).otherwise(""), F.lit('<div class="result__snippet">Near</div>'),
    )
    return X.search_results(table(spark, sf_dir, "part").select(k.alias("page_id"), html.alias("html")))
