"""Scores and ranks of candidate entities, profiles and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Word lists and domains of the scores.
TRUSTED_DOMAINS = ["wikipedia.org", "imdb.com", "www.imdb.com"]
POSITIVE_WORDS = ["official", "verified", "business", "creator", "brand", "page", "channel"]
NEGATIVE_HINTS = ["fan", "unofficial", "backup", "archive", "parody", "news", "updates"]
POSITIVE_LABELS = ["official", "verified", "business", "creator", "brand channel", "official page"]
GENERIC_WORDS = ["official", "page", "channel", "facebook", "instagram", "youtube", "twitter", "x", "imdb", "wikipedia"]
REGION_WORDS = ["au", "aus", "uk", "in", "india", "jp", "japan", "us", "usa", "ca", "canada"]
# Domains of each platform and paths that are no profile.
PLATFORM_DOMAINS = {"facebook": ["facebook.com"], "instagram": ["instagram.com"], "twitter": ["twitter.com", "x.com"], "tiktok": ["tiktok.com"], "youtube": ["youtube.com"], "wikipedia": ["wikipedia.org"], "imdb": ["imdb.com"]}
NO_PROFILE = {
    "facebook": r"/(p|pages?|profile\.php|php|groups|events|watch|posts|photos|videos|story\.php)(/|\z)", "instagram": r"^/(p|reel|reels|explore|stories|tv)(/|\z)", "twitter": r"/(status|i|search|hashtag|home|intent)(/|\z)",
    "tiktok": r"/(video|tag|music|discover)(/|\z)|^/[^@]", "youtube": r"^/(watch|shorts|playlist|results|embed)(/|\z)", "wikipedia": r"^(?!/wiki/)|^/wiki/(Special|Talk|File|Category):", "imdb": r"^(?!/(title/tt|name/nm)\d+)",
}


def _lower(c: Column | str) -> Column:
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _without(tokens: Column, words: list[str]) -> Column:
    return F.array_except(tokens, _list(words))


def _share(part: Column, whole: Column) -> Column:
    return F.size(part) / F.greatest(F.size(whole), F.lit(1))


def trusted(domain: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(domain, F.lit("")).endswith(d) for d in TRUSTED_DOMAINS])


def _held(hint: Column, text: Column) -> Column:
    """The hint isn't blank and the text holds it."""
    h = _lower(hint)
    return (h != "") & text.contains(h)


def build_candidates(results: DataFrame, query_id: str, order: str) -> DataFrame:
    """Entities of search results (title, description, key, source_domain): first hit 8 points, each more 4.

    The label is the title before " | " or " - "; without a key the label's words
    stand for it; the longest description stays.
    """
    label = F.trim(F.regexp_replace("title", r" (?:\||-) .*$", ""))
    key = F.coalesce(F.when(F.col("key") != "", F.col("key")), F.array_join(F.array_sort(T.tokens(label)), " "))
    each = results.withColumns({"label": label, "entity_key": key})
    best = lambda c: F.min_by(c, order)
    return each.groupBy(query_id, "entity_key").agg(
        best("label").alias("label"), best("source_domain").alias("source_domain"), (8.0 + 4.0 * (F.count("*") - 1)).alias("score"),
        F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col(order))).alias("description"), F.min(order).alias("position"),
    )


def score_entities(candidates: DataFrame, *, name: str = "name", label: str = "label") -> DataFrame:
    """Add ``score`` and ``evidence`` to (name, label, description, source_domain, score) rows.

    Optional columns entity_type, profession, date_of_birth and country are hints.
    """
    want, have = T.tokens(F.col(name)), T.tokens(F.col(label))
    common = F.array_intersect(want, have)
    coverage, extra = _share(common, want), F.size(F.array_except(have, want))
    n, m, about = _lower(name), _lower(label), _lower("description")
    has = lambda c: c in candidates.columns
    match = F.when(n == m, 45.0).when(n.contains(m) & (coverage >= 0.8), 18.0).when(m.contains(n), 30.0).when(F.size(common) > 0, 8 + coverage * 20).otherwise(0.0)
    parts = [("name", match), ("trusted source", F.when(trusted(F.col("source_domain")), 15.0).otherwise(0.0))]
    for hint, points in (("entity_type", 10.0), ("profession", 12.0), ("country", 8.0)):
        if has(hint):
            value = F.regexp_replace(F.col(hint), "_", " ") if hint == "entity_type" else F.col(hint)
            parts.append((hint, F.when(_held(value, about), points).otherwise(0.0)))
    if has("date_of_birth"):
        parts.append(("date of birth", F.when(_held(F.col("date_of_birth"), about), 10.0).otherwise(0.0)))
    parts.append(("missing words", F.when(coverage < 0.6, -F.round((0.6 - coverage) * 45, 1)).otherwise(0.0)))
    parts.append(("extra words", F.when((extra > 0) & (coverage < 1.0), -F.least(F.lit(10.0), extra * 2.5)).otherwise(0.0)))
    return _summed(candidates, parts, F.col("score").cast("double"), lambda s: F.round(F.least(s, F.lit(100.0)), 1))


def _summed(df: DataFrame, parts: list[tuple[str, Column]], start: Column, finish) -> DataFrame:
    evidence = F.filter(F.array(*[F.struct(F.lit(what).alias("summary"), weight.cast("double").alias("weight")) for what, weight in parts]), lambda e: e["weight"] != 0)
    total = F.aggregate(F.col("evidence"), start, lambda s, e: s + e["weight"])
    return df.withColumn("evidence", evidence).withColumn("score", finish(total))


def score_profiles(candidates: DataFrame) -> DataFrame:
    """Add confidence (``score``), label, status and evidence to profile candidates.

    Columns: name, canonical_name, source_domain (of the entity), display_name,
    title, snippet, handle, account_labels, negative_hints; entity_type and
    country are hints if present.
    """
    words = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("display_name", "title", "snippet", "handle")]))
    target = _without(F.array_union(T.tokens(F.col("name")), T.tokens(F.col("canonical_name"))), GENERIC_WORDS)
    have = _without(T.tokens(words), GENERIC_WORDS)
    common = F.array_intersect(target, have)
    coverage, extra = _share(common, target), F.array_except(have, target)
    other = F.size(_without(extra, REGION_WORDS))
    name, own = _lower("name"), _lower("canonical_name")
    match = F.when(own == _lower("display_name"), 35.0).when(words.contains(name) | words.contains(own), 25.0).when(F.size(common) > 0, 8 + coverage * 20).otherwise(0.0)
    country = _lower("country") if "country" in candidates.columns else F.lit("")
    parts = [("name", match)]
    if "entity_type" in candidates.columns:
        parts.append(("entity type", F.when(_held(F.regexp_replace("entity_type", "_", " "), words), 8.0).otherwise(0.0)))
    positive = reduce(lambda a, b: a + b, [F.when(words.contains(w), 4.0).otherwise(0.0) for w in POSITIVE_WORDS])
    count = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    parts += [
        ("country", F.when((country != "") & words.contains(country), 6.0).otherwise(0.0)), ("trusted source", F.when(trusted(F.col("source_domain")), 7.0).otherwise(0.0)),
        ("account labels", count("account_labels") * 6.0), ("positive words", positive), ("missing words", F.when(coverage < 0.55, -F.round((0.55 - coverage) * 50, 1)).otherwise(0.0)),
        ("extra words", -F.least(F.lit(12.0), other * 2.5)), ("regional", F.when((country == "") & F.arrays_overlap(extra, _list(REGION_WORDS)), -14.0).otherwise(0.0)), ("negative hints", count("negative_hints") * -18.0),
    ]
    scored = _summed(candidates, parts, F.lit(18.0), lambda s: F.round(F.greatest(F.lit(0.0), F.least(s, F.lit(100.0))), 1))
    return scored.withColumn("label", T.confidence_label(F.col("score"))).withColumn("status", F.when(F.col("score") >= 60, "found").when(F.col("score") >= 40, "uncertain").otherwise("not_found"))


def primary_and_alternates(scored: DataFrame, keys: list[str], order: list[Column], least: float = 40, alternates: int = 3) -> DataFrame:
    """Per key the best profile and up to three alternates from ``least`` on; none below it."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), *order))
    kept = scored.withColumn("rank", rank).filter((F.col("rank") <= 1 + alternates) & (F.col("score") >= least))
    return kept.withColumn("role", F.when(F.col("rank") == 1, "primary").otherwise("alternate"))


def needs_disambiguation(ranked: DataFrame, query_id: str, *, least: float | None = 70, gap: float = 12) -> DataFrame:
    """Per query: resolved or ambiguous, from its two best scores."""
    w = Window.partitionBy(query_id).orderBy(F.desc("score"))
    both = ranked.withColumns({"__r": F.row_number().over(w), "__next": F.lead("score").over(w)}).filter("__r = 1")
    unsure = F.coalesce(F.col("score") - F.col("__next") < gap, F.lit(False))
    if least is not None:
        unsure = unsure | (F.col("score") < least)
    return both.select(query_id, "score", F.when(unsure, "ambiguous").otherwise("resolved").alias("status"))


def profile_candidates(results: DataFrame, platform: str, query_id: str, order: str) -> DataFrame:
    """Search results that are profiles on a platform, the first of each account, with labels and hints."""
    url = F.col("url")
    domain = reduce(lambda a, b: a | b, [(T.host(url) == d) | T.host(url).endswith("." + d) for d in PLATFORM_DOMAINS[platform]])
    kept = results.filter(domain & (F.size(T.segments(url)) > 0) & ~T.path(url).rlike("(?i)" + NO_PROFILE[platform]))
    account = F.try_element_at(T.segments(url), F.lit(2 if platform in ("wikipedia", "imdb") else 1))
    blob = F.lower(F.concat_ws(" ", "title", "snippet"))
    holds = lambda words: F.filter(_list(words), lambda w: blob.contains(w))
    made = kept.select("*", T.canonical_url(url).alias("profile_url"), F.regexp_replace(account, "^@", "").alias("handle"), F.trim(F.regexp_replace("title", r" (?:\||-) .*$", "")).alias("display_name"), holds(POSITIVE_LABELS).alias("account_labels"), holds(NEGATIVE_HINTS).alias("negative_hints"))
    turn = F.row_number().over(Window.partitionBy(query_id, F.lower(F.coalesce("handle", "profile_url"))).orderBy(order))
    return made.withColumn("__turn", turn).filter("__turn = 1").drop("__turn").withColumn("platform", F.lit(platform))


# What each site adds to its page titles, and words that tell a title's kind.
SITE_SUFFIX = {"imdb": r"(?i)\s*-\s*IMDb\s*$", "rottentomatoes": r"(?i)\s*\|\s*Rotten Tomatoes\s*$", "metacritic": r"(?i)\s*-\s*Metacritic\s*$", "wikipedia": r"(?i)\s*-\s*Wikipedia\s*$"}
PAGE_KINDS = r"(?i)\s+(reviews|review|details|credits|cast & crew|technical specifications)\s*$"
TV_WORDS, MOVIE_WORDS = ["tv", "television", "series", "season", "episode", "show"], ["film", "movie", "theatrical"]


def clean_page_title(title: Column, site: Column) -> Column:
    out = T.squeeze(title)
    for name, suffix in SITE_SUFFIX.items():
        out = F.when(site == name, F.regexp_replace(out, suffix, "")).otherwise(out)
    return F.trim(F.regexp_replace(out, PAGE_KINDS, ""))


def site_url(url: Column, site: Column) -> Column:
    """The canonical page of a title on a site, or null if the URL is no such page."""
    host, path = T.host(url), T.path(url)
    wiki = F.when((host == "en.wikipedia.org") & path.startswith("/wiki/") & ~F.lower(path).contains("disambiguation"), F.concat(F.lit("https://en.wikipedia.org"), path))
    imdb = F.regexp_extract(path, r"(?i)/title/(tt\d+)", 1)
    kind = F.when(site == "rottentomatoes", F.regexp_extract(path, r"(?i)/(m|tv)/([^/?#]+)", 1)).otherwise(F.regexp_extract(path, r"(?i)/(movie|tv)/([^/?#]+)", 1))
    name = F.when(site == "rottentomatoes", F.regexp_extract(path, r"(?i)/(m|tv)/([^/?#]+)", 2)).otherwise(F.regexp_extract(path, r"(?i)/(movie|tv)/([^/?#]+)", 2))
    return (
        F.when(site == "wikipedia", wiki)
        .when((site == "imdb") & (imdb != ""), F.concat(F.lit("https://"), host, F.lit("/title/"), F.lower(imdb)))
        .when(site.isin("rottentomatoes", "metacritic") & (name != ""), F.concat(F.lit("https://"), host, F.lit("/"), F.lower(kind), F.lit("/"), name))
    )


def title_kind_of_page(url: Column, text: Column, site: Column) -> Column:
    words = F.split(T.norm_lookup(F.concat_ws(" ", url, text)), " ")
    by_words = F.when(F.arrays_overlap(words, _list(TV_WORDS)), "tv").when(F.arrays_overlap(words, _list(MOVIE_WORDS)), "movie").otherwise("any")
    by_path = F.when(site.isin("rottentomatoes", "metacritic") & url.contains("/tv/"), "tv").when((site == "rottentomatoes") & url.contains("/m/"), "movie").when((site == "metacritic") & url.contains("/movie/"), "movie")
    return F.coalesce(by_path, by_words)


def score_title_pages(results: DataFrame, *, query_id: str, least: float = 35, id_paths: tuple[str, ...] = ()) -> DataFrame:
    """Pages of (query title, title_type, year) among (site, url, page_title, snippet, position), best per page.

    Order within a query and site: score, then URL.  Paths of the sites ``id_paths``
    hold ids and no names: they give no points, as "it" in "/title/" would.
    """
    site, want = F.col("site"), T.norm_lookup(F.regexp_replace("query_title", "&", " "))
    made = results.withColumn("page_url", site_url(F.col("url"), site)).filter("page_url IS NOT NULL")
    title = clean_page_title(F.col("page_title"), site)
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    shown, slug = plain(title), plain(F.coalesce(F.try_url_decode(T.path(F.col("page_url"))), F.lit("")))
    everything = plain(F.concat_ws(" ", title, "snippet", "page_url"))
    words = F.array_distinct(F.split(want, " "))
    share = lambda c: _share(F.array_intersect(words, F.array_distinct(F.split(c, " "))), words)
    name = F.when(want == shown, 72.0).when(shown.contains(want), 58.0).when(everything.contains(want), 46.0).otherwise(share(everything) * 34)
    path = F.when(slug.contains(want), 18.0).otherwise(share(slug) * 10)
    if id_paths:
        path = F.when(site.isin(*id_paths), 0.0).otherwise(path)
    place = F.when(F.coalesce("position", F.lit(0)) > 0, F.greatest(F.lit(0), 11 - F.col("position"))).otherwise(0)
    years = F.regexp_extract_all(F.concat_ws(" ", title, "snippet", "page_url"), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    asked = F.coalesce(F.col("year").cast("string"), F.lit(""))
    year = F.when(asked == "", 0).when(F.array_contains(years, asked), 20).when(F.size(years) > 0, -10).otherwise(0)
    kind, wanted = title_kind_of_page(F.col("page_url"), F.concat_ws(" ", title, "snippet"), site), F.col("title_type")
    agree = F.when(wanted == "any", 0).when(kind == wanted, 12).when(kind != "any", -9).otherwise(0)
    low = F.lower("page_url")
    bonus = (
        F.when((site == "wikipedia") & (wanted == "movie") & low.contains("_film"), 10).when((site == "wikipedia") & (wanted == "tv") & (low.contains("television_series") | low.contains("_tv_series")), 10)
        .when((site == "imdb") & low.rlike(r"/title/tt\d+"), 10).when((site == "rottentomatoes") & low.rlike(r"/(m|tv)/[^/]+$"), 10).when((site == "metacritic") & low.rlike(r"/(movie|tv)/[^/]+$"), 10).otherwise(0)
    )
    scored = made.withColumn("score", F.round(name + path + place + year + agree + bonus, 2)).filter(F.col("score") >= least)
    best = scored.groupBy(query_id, "site", "page_url").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query_id, "site").orderBy(F.desc("score"), "page_url")))


# Score bands of social hits and their weights.
HIT_BANDS = [(0.82, "High"), (0.58, "Medium"), (0.44, "Low")]


def score_social_hits(hits: DataFrame, *, key: list[str], order: str) -> DataFrame:
    """The kept hit per key: a later hit replaces the kept one only if its band is better.

    Columns: title, snippet, name, handle, knowledge_graph (boolean).  The fold
    runs over each key's hits in order.
    """
    blob = _lower(F.concat_ws(" ", "title", "snippet"))
    want = T.tokens(F.col("name"))
    overlap = _share(F.array_intersect(want, T.tokens(F.concat_ws(" ", "title", "snippet", "handle"))), want)
    negative = reduce(lambda a, b: a | b, [blob.contains(w) for w in NEGATIVE_HINTS])
    in_handle = (F.coalesce("handle", F.lit("")) != "") & _lower("handle").contains(F.regexp_replace(_lower("name"), "[^a-z0-9]", ""))
    points = [("official", 0.25), ("verified", 0.05)]
    score = 0.25 + 0.35 * overlap + reduce(lambda a, b: a + b, [F.when(blob.contains(w), n).otherwise(0.0) for w, n in points])
    score = score + F.when(F.col("knowledge_graph"), 0.35).otherwise(0.0) - F.when(negative, 0.4).otherwise(0.0) + F.when(in_handle, 0.15).otherwise(0.0)
    band = F.when(F.col("score") >= 0.82, 3).when(F.col("score") >= 0.58, 2).when(F.col("score") >= 0.44, 1).otherwise(0)
    scored = hits.withColumn("score", score).withColumn("band", band).filter("band > 0")
    item = F.struct(order, "band", "score", "url")
    all_hits = scored.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("hits"))
    kept = F.reduce("hits", F.element_at("hits", 1), lambda best, x: F.when(x["band"] > best["band"], x).otherwise(best))
    return all_hits.select(*key, kept.alias("__kept")).select(*key, "__kept.url", "__kept.score", T.banded(F.col("__kept.score"), HIT_BANDS, "None").alias("band"))


def select_artist(hits: DataFrame, query_id: str, order: str, keywords: dict[str, int]) -> DataFrame:
    """The hit with most points from keywords in its text (negative ones count against it), first of equals."""
    blob = _lower(F.concat_ws(" ", "label", "description"))
    points = reduce(lambda a, b: a + b, [F.when(blob.contains(w), n).otherwise(0) for w, n in keywords.items()], F.when(_lower("label") == _lower("name"), 5).otherwise(0))
    ranked = hits.withColumn("score", points)
    turn = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), order))
    return ranked.withColumn("__turn", turn).filter("__turn = 1").drop("__turn")


# Which host belongs to which platform of official links.
LINK_HOSTS = {"facebook.com": "facebook", "instagram.com": "instagram", "twitter.com": "twitter", "x.com": "twitter", "tiktok.com": "tiktok", "youtube.com": "youtube", "wikipedia.org": "wikipedia", "imdb.com": "imdb", "threads.net": "threads", "linkedin.com": "linkedin", "pinterest.com": "pinterest"}


def links_from_pages(pages: DataFrame, *, page_id: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All distinct links of pages: absolute URL, host, platform (null for others)."""
    href = pages.select(page_id, F.col(url_col).alias("base"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']([^\"'#]+)"), F.lit(1)))).alias("href"))
    root = F.regexp_extract("base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace("base", r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    h = F.col("href")
    full = F.when(h.rlike(r"^(?i)https?://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.startswith("/"), F.concat(root, h)).when(h.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), F.lit(None)).otherwise(F.concat(folder, F.lit("/"), h))
    links = href.withColumn("link", full).filter("link IS NOT NULL").withColumn("host", T.host(F.col("link")))
    platform = F.coalesce(*[F.when((F.col("host") == d) | F.col("host").endswith("." + d), p) for d, p in LINK_HOSTS.items()])
    return links.select(page_id, "link", "host", platform.alias("platform")).distinct()


# Properties of a knowledge-base item that hold an account or id, and the addresses they make.
CLAIM_LINKS = [
    ("P2013", "facebook", "https://www.facebook.com/", "Username from Wikidata"), ("P2003", "instagram", "https://www.instagram.com/", "Username from Wikidata"), ("P2002", "twitter", "https://x.com/", "Username from Wikidata"),
    ("P7085", "tiktok", "https://www.tiktok.com/@", "Username from Wikidata"), ("P2397", "youtube", "https://www.youtube.com/channel/", "Channel id from Wikidata"), ("P345", "imdb", "https://www.imdb.com/", "IMDb id from Wikidata"),
]
WEBSITE_CLAIM = "P856"
ID_PATHS = {"tt": "title/", "nm": "name/", "co": "company/"}
CLAIMS_SCHEMA = "map<string,array<struct<mainsnak:struct<datavalue:struct<type:string,value:string>>>>>"


def claim_values(claims: Column) -> Column:
    """Map of property to its first text value, from the claims of an item as JSON; other values don't count."""
    parsed = F.from_json(claims, CLAIMS_SCHEMA)
    held = lambda c: F.when(F.coalesce(c["mainsnak"]["datavalue"]["type"] == "string", ~c["mainsnak"]["datavalue"]["value"].startswith("{")), c["mainsnak"]["datavalue"]["value"])
    texts = F.transform_values(parsed, lambda _, v: F.filter(F.transform(v, held), lambda x: x.isNotNull()))
    return F.transform_values(F.map_filter(texts, lambda k, v: F.size(v) > 0), lambda _, v: F.get(v, F.lit(0)))


def profile_url(url: Column) -> Column:
    """Scheme, host in lower case without www., path without slashes at its end."""
    scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("")), F.lit("https"))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.concat(scheme, F.lit("://"), host, path)


def account_of(url: Column) -> Column:
    """The account in a profile address: its first path segment, the second after words like channel; null without one."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    typed = F.get(parts, F.lit(0)).isin("channel", "user", "c", "title", "name", "company") & (F.size(parts) > 1)
    return F.when(typed, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))


def links_from_claims(items: DataFrame, *, key: str, claims: str = "claims", page_url: str | None = None) -> DataFrame:
    """Profile links of knowledge-base items: key, platform, url, handle, evidence, official_website.

    ``claims`` is the items' JSON of properties; each property's first text value
    counts.  With ``page_url``, pages of the encyclopedia are links as well.  Links that are
    equal in any case are given once; items without links have no rows.
    """
    held = items.select(key, claim_values(F.col(claims)).alias("v"), *([F.col(page_url).alias("page")] if page_url else []))

    def link(prop: str, platform: str, start: str, evidence: str) -> Column:
        value = F.nullif(F.try_element_at("v", F.lit(prop)), F.lit(""))
        if platform == "tiktok":
            value = F.regexp_replace(value, "^@+", "")
        if platform == "imdb":
            value = F.concat(F.coalesce(*[F.when(value.startswith(p), path) for p, path in ID_PATHS.items()], F.lit("")), value)
        return F.when(value.isNotNull(), F.struct(F.lit(platform).alias("platform"), profile_url(F.concat(F.lit(start), value)).alias("url"), F.lit(evidence).alias("evidence")))

    made = [link(*x) for x in CLAIM_LINKS]
    if page_url:
        made.append(F.when(T.host(F.col("page")).endswith("wikipedia.org"), F.struct(F.lit("wikipedia").alias("platform"), profile_url(F.col("page")).alias("url"), F.lit("Canonical Wikipedia page").alias("evidence"))))
    rows = held.select(key, F.try_element_at("v", F.lit(WEBSITE_CLAIM)).alias("official_website"), F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))
    return rows.select(key, "platform", "url", account_of(F.col("url")).alias("handle"), "evidence", "official_website")
