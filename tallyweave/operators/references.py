"""Checks of a table against reference data: look-ups that were network calls are joins here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import ratio_pairs, sequence_ratio

# What stands for nothing in audited cells, and the years that dates may have.
PLACEHOLDERS = ["-", "N/A", "#NA"]
GENRE_PLACEHOLDERS = [*PLACEHOLDERS, "null", "none"]
FIRST_YEAR, LAST_YEAR = 1920, 2035
# Which reference types fit a title category.
CATEGORY_TYPES = {"movies": ["movie", "film", "tvmovie", "short"], "tv shows": ["tvseries", "tvminiseries", "tv series", "television series", "series"], "talent": ["person", "human"]}
# Studios that count as major.
MAJOR_STUDIOS = ["warner bros. pictures", "warner bros", "universal pictures", "paramount pictures", "walt disney pictures", "pixar", "marvel studios", "20th century studios", "columbia pictures", "sony pictures", "sony pictures entertainment"]


def _first(*cases: Column) -> Column:
    return F.coalesce(*cases)


def entity_metadata(df: DataFrame, reference: DataFrame, *, row_col: str = "row_num") -> DataFrame:
    """Join each row's entity: by IMDb id if it has one, else by title among movies, shows, or movies then shows.

    ``reference``: imdb_id, kind (movie or tv), title_norm, genres, release_date,
    networks, companies.  Three equi-joins on distinct keys; no row multiplies.
    """
    facts = F.struct("genres", "release_date", "networks", "companies").alias("m")
    by_id = reference.filter("imdb_id IS NOT NULL").select(F.lower("imdb_id").alias("__id"), facts).dropDuplicates(["__id"]).withColumnRenamed("m", "__by_id")
    named = reference.select("title_norm", "kind", facts).dropDuplicates(["title_norm", "kind"])
    movies = named.filter("kind = 'movie'").select(F.col("title_norm").alias("__title"), F.col("m").alias("__movie"))
    shows = named.filter("kind = 'tv'").select(F.col("title_norm").alias("__title2"), F.col("m").alias("__tv"))
    category = T.norm_value(F.col("title_category"))
    keyed = df.withColumns({"__id": T.title_id(F.col("imdb_id")), "__title": T.norm_title(F.col("title"))})
    joined = keyed.join(by_id, "__id", "left").join(movies, "__title", "left").join(shows, F.col("__title") == F.col("__title2"), "left")
    named_fact = F.when(category == "movies", F.col("__movie")).when(category == "tv shows", F.col("__tv")).otherwise(F.coalesce("__movie", "__tv"))
    return joined.withColumn("entity", F.when(F.col("__id").isNotNull(), F.col("__by_id")).otherwise(named_fact)).drop("__id", "__title", "__title2", "__by_id", "__movie", "__tv")


def _cell_codes(value: Column, what: str, placeholders: list[str]) -> list[Column]:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return [
        F.when(T.is_blank(value), f"PLACEHOLDER: {what} is blank"), F.when(T.text(value).isin(placeholders), f"PLACEHOLDER: {what} contains placeholder"),
        F.when(text != T.text(value), f"FORMAT_ERROR: {what} has trailing newlines or whitespace"),
    ]


def genre_audit(value: Column, entity: Column, unavailable: str | None = "No reference data found") -> Column:
    """Message of the genre audit, or null if the cell passes."""
    expected = F.transform(entity["genres"], lambda g: T.genre(g))
    actual = F.transform(T.multi_values(value), lambda g: T.genre(g))
    wrong = F.array_except(actual, expected)
    none = F.when(entity.isNull(), unavailable) if unavailable else F.when(entity.isNull(), F.lit(""))
    message = _first(*_cell_codes(value, "Genre", GENRE_PLACEHOLDERS), none, F.when(F.size(F.coalesce(expected, F.array())) == 0, "The reference has no genres"), F.when(F.size(wrong) > 0, F.concat(F.lit("GENRE_MISMATCH: "), F.array_join(F.array_sort(wrong), ", "))))
    return F.nullif(message, F.lit(""))


def date_audit(value: Column, entity: Column, unavailable: str | None = "No reference data found") -> Column:
    """Message of the date audit, or null."""
    year = F.year(F.try_to_date(F.substring(entity["release_date"], 1, 10), "yyyy-MM-dd"))
    none = F.when(entity.isNull(), unavailable) if unavailable else F.when(entity.isNull(), F.lit(""))

    def message(day: Column) -> Column:
        return _first(
            *_cell_codes(value, "Date", PLACEHOLDERS), F.when(day.isNull(), "FORMAT_ERROR: Date is not in a valid format"), F.when((F.year(day) < FIRST_YEAR) | (F.year(day) > LAST_YEAR), "FORMAT_ERROR: anomalous year (suspected typo)"),
            none, F.when(year.isNull(), "The reference has no release date"), F.when(F.year(day) != year, "DATE_MISMATCH: year does not match the reference"),
        )

    # the date is parsed once, by a dozen patterns, and named within an array of one
    return F.nullif(F.transform(F.array(T.date(value)), message)[0], F.lit(""))


def network_audit(value: Column, entity: Column, unavailable: str | None = "No reference data found") -> Column:
    """Message of the network audit, or null: some network or company holds the cell or is held by it."""
    empty = F.array().cast("array<string>")
    expected = F.transform(F.concat(F.coalesce(entity["networks"], empty), F.coalesce(entity["companies"], empty)), lambda n: T.norm_value(n))
    actual = T.norm_value(value)
    none = F.when(entity.isNull(), unavailable) if unavailable else F.when(entity.isNull(), F.lit(""))
    message = _first(*_cell_codes(value, "Network", PLACEHOLDERS), none, F.when(F.size(expected) == 0, "The reference has no network or company"), F.when(~F.exists(expected, lambda n: n.contains(actual) | actual.contains(n)), "NETWORK_MISMATCH: not in the reference"))
    return F.nullif(message, F.lit(""))


def url_audit(value: Column, title: Column, page_title: Column, kind: str) -> Column:
    """Message of the Wikipedia or IMDb audit, or null; ``page_title`` is what the reference calls the page."""
    code = kind.upper()
    form = T.valid_url(T.text(value)) & F.lower(value).contains("wikipedia.org") if kind == "wikipedia" else T.title_id(value).isNotNull()
    return _first(
        F.when(T.is_blank(value), f"MISSING_{code}: value is missing"), F.when(~F.coalesce(form, F.lit(False)), "FORMAT_ERROR: value has not the form of a reference"), F.when(T.is_blank(title), "title is missing in row context"),
        F.when(page_title.isNull(), "The reference has no such page"), F.when(~T.loosely_equal(T.norm_title(title), T.norm_title(page_title)), f"{code}_MISMATCH: title does not match"),
    )


def type_fits(category: Column, kind: Column) -> Column:
    """A reference type fits a title category; unknown categories and types fit."""
    c, k = T.norm_value(category), T.norm_value(kind)
    bad = [(c == name) & (k != "") & ~k.isin(kinds) for name, kinds in CATEGORY_TYPES.items()]
    return ~reduce(lambda a, b: a | b, bad)


def reference_match(df: DataFrame, reference: DataFrame, *, value_col: str, platform: str, extract: Column | None = None) -> DataFrame:
    """Add ``finding`` (null: passes) of reference cells against (ref_id, titles array, wikidata_id, type).

    Blank cells pass; some title must match loosely; for Wikidata a stated id
    must be the reference's; the type must fit ``title_category``.
    """
    value = F.col(value_col)
    key = extract if extract is not None else T.title_id(value) if platform == "imdb" else T.item_id(value) if platform == "wikidata" else F.lower(T.wiki_slug(value))
    ref = reference.select(F.lower("ref_id").alias("__k"), F.struct("titles", "wikidata_id", "type").alias("__r"))
    joined = df.withColumn("__k", F.lower(key)).join(ref, "__k", "left")
    r, title = F.col("__r"), T.norm_title(F.col("title"))
    stated = T.item_id(F.col("wikidata_id")) if "wikidata_id" in df.columns else F.lit(None).cast("string")
    finding = F.when(T.text(value) != "", _first(
        F.when(value.rlike(r"\p{Cntrl}"), "value contains a line break or other non-printable character"), F.when(T.is_blank(F.col("title")), "title is missing, so the reference cannot be verified"), F.when(r.isNull(), "reference not found"),
        F.when(~F.exists(r["titles"], lambda t: T.loosely_equal(title, T.norm_title(t))), "title differs"), F.when((F.lit(platform) != "imdb") & (F.lower(stated) != F.lower(r["wikidata_id"])), "Wikidata id differs"),
        F.when(~type_fits(F.col("title_category"), r["type"]), "type differs"),
    ))
    return joined.withColumn("finding", finding).drop("__k", "__r")


def movie_checks(df: DataFrame, movies: DataFrame) -> DataFrame:
    """Findings of date, release type, genre set and film-page URL against movies (title_norm, year, us_date, general_date, release_type, genres, page_url).

    Rows without a movie in the reference are skipped.
    """
    ref = movies.select(F.col("title_norm").alias("__t"), F.col("year").alias("__y"), F.struct("us_date", "general_date", "release_type", "genres", "page_url").alias("__m")).dropDuplicates(["__t", "__y"])
    day = T.date(F.col("released_on"))
    joined = df.withColumns({"__t": T.norm_title(F.col("title")), "__y": F.coalesce(F.year(day), F.lit(0))}).join(ref, ["__t", "__y"])
    m = F.col("__m")
    want_day = F.coalesce(m["general_date"], m["us_date"])
    actual = F.array_sort(F.array_distinct(F.transform(T.multi_values(F.col("primary_genre")), lambda g: T.genre(g))))
    wanted = F.array_sort(F.array_distinct(F.transform(m["genres"], lambda g: T.genre(g))))
    tests = {
        "release_date": want_day.isNotNull() & (F.date_format(day, "yyyy-MM-dd") != want_day), "release_type": (T.norm_value(m["release_type"]) != "") & (T.norm_value(F.col("release_type")) != T.norm_value(m["release_type"])),
        "genre": (F.size(F.coalesce(wanted, F.array())) > 0) & (actual != wanted), "film_page": m["page_url"].isNotNull() & ~film_page(F.col("film_page_url")).eqNullSafe(film_page(m["page_url"])),
    }
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    return joined.withColumn("finding", F.explode(found)).drop("__t", "__y", "__m")


def film_page(c: Column) -> Column:
    """Canonical film page of the review site, from a URL, host path or path; null for others."""
    value = T.text(c)
    full = F.when(value.startswith("/"), F.concat(F.lit("https://www.rottentomatoes.com"), value)).when(F.lower(value).startswith("www.rottentomatoes.com/") | F.lower(value).startswith("rottentomatoes.com/"), F.concat(F.lit("https://"), value)).otherwise(value)
    path = F.regexp_replace(T.path(full), r"/+\z", "")
    return F.when(T.host(full).contains("rottentomatoes.com") & F.lower(path).startswith("/m/"), F.concat(F.lit("https://www.rottentomatoes.com"), path))


def reachable(df: DataFrame, fetched: DataFrame, *, value_col: str, platform: str) -> DataFrame:
    """Findings of references against fetched pages (url, status, final_url, text): missing, status, moved, friends, unrelated."""
    pages = fetched.select(T.canonical_url(F.col("url")).alias("__u"), F.struct("status", "final_url", "text").alias("__p")).dropDuplicates(["__u"])
    joined = df.withColumn("__u", T.canonical_url(F.col(value_col))).filter("__u IS NOT NULL").join(pages, "__u", "left")
    p, body = F.col("__p"), F.lower(F.coalesce(F.col("__p.text"), F.lit("")))
    words = F.filter(T.tokens(F.col("title")), lambda w: F.length(w) > 2)
    finding = _first(
        F.when(p.isNull(), "unable to verify: not fetched"), F.when(p["status"] == 404, "HTTP 404"), F.when(p["status"] == 403, "HTTP 403 forbidden"), F.when(p["status"] >= 400, F.concat(F.lit("unable to verify: HTTP "), p["status"].cast("string"))),
        F.when(p["final_url"].isNotNull() & (T.host(p["final_url"]) != T.host(F.col("__u"))), "redirects to another site"),
        F.when((F.lit(platform) == "facebook") & body.contains(" friends") & ~body.contains("followers"), "shows friends instead of followers"),
        F.when((F.size(words) > 0) & (body != "") & ~F.exists(words, lambda w: body.contains(w)), "content does not appear related to title"),
    )
    return joined.withColumn("finding", finding).filter("finding IS NOT NULL").drop("__u", "__p")


def studio_type(names: Column) -> Column:
    low = F.transform(names, lambda n: T.norm_value(n))
    return F.when(F.size(F.coalesce(low, F.array())) == 0, "").when(F.arrays_overlap(low, F.array(*[F.lit(s) for s in MAJOR_STUDIOS])), "Major").otherwise("Independent")


def fuzzy_roster_match(names: DataFrame, roster: DataFrame, *, name_col: str = "name", roster_col: str = "name", cutoff: float = 0.85) -> DataFrame:
    """Each distinct name with its roster entry: equal in any case, else the most similar from ``cutoff`` on.

    Names without an equal entry are compared with every entry, in blocks; of entries alike the last in code-point order counts.
    """
    n = names.select(F.lower(F.trim(name_col)).alias("target")).filter("target <> ''").distinct()
    r = roster.select(F.lower(F.trim(roster_col)).alias("entry")).filter("entry <> ''").distinct()
    exact = n.join(r, F.col("target") == F.col("entry")).select("target", "entry", F.lit(1.0).alias("score"))
    near = ratio_pairs(n.join(exact.select("target"), "target", "left_anti"), r, cutoff)
    best = near.groupBy("target").agg(F.max_by(F.struct("entry", "score"), F.struct("score", "entry")).alias("b")).select("target", "b.entry", "b.score")
    return exact.unionByName(best).withColumn("score", F.round("score", 3))


def chart_new_entries(chart: DataFrame, roster: DataFrame, *, name: str = "name", last_week: str = "last_week", fill: tuple[str, ...] = (), cutoff: float = 0.85) -> DataFrame:
    """New entries of a chart (last week "-" or blank) with their roster match.

    Adds ``in_roster``, ``roster_match`` and ``score``; the columns ``fill`` are
    taken from the roster where the chart has none. Of roster rows that are equal in any case the first by name counts.
    """
    new = chart.filter(F.trim(F.coalesce(F.col(last_week).cast("string"), F.lit(""))).isin("", "-", "\u2013", "\u2014", "NEW"))
    target = F.lower(F.trim(name))
    match = fuzzy_roster_match(new, roster, name_col=name, roster_col="name", cutoff=cutoff)
    entry = roster.groupBy(F.lower(F.trim("name")).alias("entry")).agg(F.min(F.struct("name", *fill)).alias("r"))
    joined = new.withColumn("target", target).join(match.join(entry, "entry"), "target", "left")
    kept = [c for c in new.columns if c not in fill]
    filled = [F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")) if c in new.columns else F.lit(None), F.col("r").getField(c)).alias(c) for c in fill]
    return joined.select(*kept, *filled, F.col("r").isNotNull().alias("in_roster"), F.coalesce(F.col("r")["name"], F.lit("")).alias("roster_match"), F.coalesce("score", F.lit(0.0)).alias("score"))


def chart_totals(entries: DataFrame) -> DataFrame:
    """How many new entries there are, and how many of them no roster has."""
    return entries.agg(F.count("*").alias("new_entries"), F.count_if(~F.col("in_roster")).alias("not_in_roster"))


def title_similarity(query: Column, candidate: Column) -> Column:
    """1.2 for equal titles; at least .9 if one holds the other; else .7 of the ratio and .3 of the word overlap."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    q, c = plain(query), plain(candidate)
    ratio = sequence_ratio(q, c)
    words = F.array_distinct(F.split(q, " "))
    overlap = F.size(F.array_intersect(words, F.array_distinct(F.split(c, " ")))) / F.greatest(F.size(words), F.lit(1))
    return F.when((q == "") | (c == ""), 0.0).when(q == c, 1.2).when(c.contains(q) | q.contains(c), F.greatest(ratio, F.lit(0.9))).otherwise(ratio * 0.7 + overlap * 0.3)


def best_candidate(results: DataFrame, *, query_id: str, most: int = 8, least: float = 0.54) -> DataFrame:
    """The best of each query's first ``most`` results per type (query, preferred_type, type, title, popularity, position)."""
    w = Window.partitionBy(query_id, "type").orderBy("position")
    top = results.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most)
    score = title_similarity(F.col("query"), F.col("title")) + F.when(F.col("type") == F.col("preferred_type"), 0.08).otherwise(0.0) + F.least(F.coalesce("popularity", F.lit(0.0)) / 1000, F.lit(0.03))
    scored = top.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), (F.col("type") == F.col("preferred_type")).desc(), "position"))
    return scored.withColumn("__n", rank).filter((F.col("__n") == 1) & (F.col("score") >= least)).drop("__n")


def merge_wikimedia(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Reference rows of wiki pages (page_title, missing, disambiguation, item_id, redirected_from) and items (item_id, labels, aliases, instance_of).

    Missing pages, disambiguation pages and pages without an item are rejected
    with a reason; titles are the page title first, then labels, aliases and the
    redirect's source, each once.
    """
    joined = pages.join(items.select("item_id", "labels", "aliases", "instance_of"), "item_id", "left")
    reason = F.when(F.col("missing"), "page is missing").when(F.col("disambiguation"), "disambiguation page").when(F.col("item_id").isNull(), "page has no item")
    empty = F.array().cast("array<string>")
    titles = F.array_distinct(F.filter(F.concat(F.array("page_title"), F.coalesce("labels", empty), F.coalesce("aliases", empty), F.array("redirected_from")), lambda t: t.isNotNull() & (t != "")))
    human = F.array_contains(F.coalesce("instance_of", empty), "Q5")
    film = F.arrays_overlap(F.coalesce("instance_of", empty), F.array(F.lit("Q11424"), F.lit("Q506240")))
    show = F.arrays_overlap(F.coalesce("instance_of", empty), F.array(F.lit("Q5398426"), F.lit("Q1259759")))
    return joined.select("page_title", F.col("item_id").alias("wikidata_id"), reason.alias("reject_reason"), F.when(reason.isNull(), titles).alias("titles"), F.when(human, "person").when(film, "movie").when(show, "tvseries").otherwise("").alias("type"))


def reference_records(titles: DataFrame, people: DataFrame) -> DataFrame:
    """(ref_id, titles, type) of title and person tables, as ``reference_match`` takes them."""
    t = titles.select(F.col("tconst").alias("ref_id"), F.array_distinct(F.filter(F.array("primary_title", "original_title"), lambda x: x.isNotNull())).alias("titles"), F.lower(T.title_kind(F.col("title_type"))).alias("type"))
    p = people.select(F.col("nconst").alias("ref_id"), F.array("primary_name").alias("titles"), F.lit("person").alias("type"))
    return t.unionByName(p).withColumn("wikidata_id", F.lit(None).cast("string"))


def verify_page(selected: DataFrame) -> DataFrame:
    """Add ``mismatch`` of a selected page (query, year, page_title, page_year, result_year): title, year, or null."""
    year = F.coalesce("page_year", "result_year")
    title = T.norm_title(F.col("query")) == T.norm_title(F.col("page_title"))
    return selected.withColumn("mismatch", F.when(~F.coalesce(title, F.lit(False)), "title").when(F.col("year").isNotNull() & (year.isNull() | (year != F.col("year"))), "year"))


def clean_request(title: Column) -> Column:
    """struct(title, kind): season marks removed; a title with one is a show, others movies."""
    mark = r"(?i)\b(?:Season\s+\d+|S\d+)\b"
    bare = F.regexp_replace(T.squeeze(F.regexp_replace(title, mark, "")), r"^[ \-:]+|[ \-:]+$", "")
    return F.struct(F.when(bare == "", title).otherwise(bare).alias("title"), F.when(title.rlike(r"(?i)\bS(?:eason)?\s*\d+\b"), "tv").otherwise("movie").alias("kind"))


def with_overrides(requests: DataFrame, overrides: DataFrame) -> DataFrame:
    """Requests (title) cleaned, or as a table of overrides (title, search_title, kind) says."""
    joined = requests.join(overrides.select("title", F.struct(F.col("search_title").alias("title"), "kind").alias("__o")), "title", "left")
    return joined.withColumn("__r", F.coalesce("__o", clean_request(F.col("title")))).select(*requests.columns, F.col("__r.title").alias("search_title"), F.col("__r.kind").alias("search_kind"))


def flatten_search_payload(payloads: DataFrame, *, key: str, payload: str = "payload") -> DataFrame:
    """Candidate rows of search payloads: knowledge-graph profiles, organic results each with its inline links, in that order."""
    link = "struct<name:string,title:string,link:string>"
    schema = f"struct<knowledge_graph:struct<profiles:array<{link}>,social_profiles:array<{link}>>,organic_results:array<struct<title:string,link:string,snippet:string,sitelinks:struct<inline:array<{link}>>>>>"
    p = payloads.select(key, F.from_json(payload, schema).alias("p"))
    none = F.expr(f"CAST(array() AS array<{link}>)")
    graph = p.select(key, F.posexplode(F.concat(F.coalesce("p.knowledge_graph.profiles", none), F.coalesce("p.knowledge_graph.social_profiles", none))).alias("i", "x"))
    graph = graph.select(key, F.struct(F.lit(0).alias("a"), F.col("i").alias("b"), F.lit(0).alias("c")).alias("seq"), F.coalesce("x.name", "x.title", F.lit("")).alias("title"), "x.link", F.lit("").alias("snippet"), F.lit("knowledge graph").alias("origin"))
    organic = p.select(key, F.posexplode("p.organic_results").alias("i", "x"))
    own = organic.select(key, F.struct(F.lit(1).alias("a"), F.col("i").alias("b"), F.lit(0).alias("c")).alias("seq"), F.coalesce("x.title", F.lit("")).alias("title"), "x.link", F.coalesce("x.snippet", F.lit("")).alias("snippet"), F.lit("organic").alias("origin"))
    inner = organic.select(key, "i", "x", F.posexplode("x.sitelinks.inline").alias("j", "y"))
    inner = inner.select(key, F.struct(F.lit(1).alias("a"), F.col("i").alias("b"), (F.col("j") + 1).alias("c")).alias("seq"), F.coalesce("y.title", "x.title", F.lit("")).alias("title"), "y.link", F.coalesce("x.snippet", F.lit("")).alias("snippet"), F.lit("sitelink").alias("origin"))
    return graph.unionByName(own).unionByName(inner)


def hits_to_results(hits: DataFrame, sitelinks: DataFrame, *, query_id: str, item: str = "item_id", order: str = "position") -> DataFrame:
    """Search hits as results: the article's URL if the item has one, else the item's; positions from 1."""
    joined = hits.join(sitelinks.select(item, F.col("article").alias("__a")), item, "left")
    url = F.when(F.col("__a").isNotNull(), F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(F.col("__a"), F.lit(" "), F.lit("_")))).otherwise(F.concat(F.lit("https://www.wikidata.org/wiki/"), F.col(item)))
    return joined.withColumn("url", url).withColumn("position", F.row_number().over(Window.partitionBy(query_id).orderBy(order, item))).drop("__a")


def youtube_label_fits(value: Column, title: Column) -> Column:
    """An @handle, /c/ or /user/ name loosely matches the title; channel ids and blanks fit."""
    label = F.coalesce(F.nullif(F.regexp_extract(value, r"(?:/c/|/user/|@)([^/?#\s]+)", 1), F.lit("")), F.lit(""))
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    a, b = plain(label), plain(T.norm_title(title))
    return (a == "") | ((b != "") & (a.contains(b) | b.contains(a)))


def table_checks(row_col: str = "row_num", *, entities: DataFrame | None = None, movies: DataFrame | None = None, references: DataFrame | None = None, pages: DataFrame | None = None) -> dict:
    """The ``refs`` of ``rules.validate`` for the tables at hand.

    ``entities`` as in ``entity_metadata``, ``movies`` as in ``movie_checks``,
    ``references`` (platform, ref_id, titles, wikidata_id, type) and fetched
    ``pages`` (url, status, final_url, text).
    """
    checks = {}

    def failures(df: DataFrame, message: Column, value: str) -> DataFrame:
        return df.select(row_col, message.alias("message"), F.col(value).alias("value")).filter("message IS NOT NULL")

    if entities is not None:
        for check, audit in (("genre_taxonomy_audit", genre_audit), ("date_cross_check", date_audit), ("network_platform_audit", network_audit)):
            checks[check] = lambda df, r, audit=audit: failures(entity_metadata(df, entities), audit(F.col(r.column), F.col("entity")), r.column)
    if movies is not None:
        for check, name in (("movie_us_release_date_match", "release_date"), ("movie_release_type_match", "release_type"), ("movie_genre_match", "genre"), ("rottentomatoes_url_match", "film_page")):
            checks[check] = lambda df, r, name=name: failures(movie_checks(df, movies).filter(F.col("finding") == name), F.lit(r.message or f"{r.column} does not match the movie reference."), r.column)
    if references is not None:
        checks["reference_lookup_match"] = lambda df, r: failures(reference_match(df, references.filter(F.col("platform") == r.platform), value_col=r.column, platform=r.platform), F.col("finding"), r.column)
        for kind in ("wikipedia", "imdb"):

            def audit_urls(df, r, kind=kind):
                key = F.lower(wiki_key(F.col(r.column)) if kind == "wikipedia" else T.title_id(F.col(r.column)))
                ref = references.filter(F.col("platform") == kind).select(F.lower("ref_id").alias("__k"), F.col("titles")[0].alias("__page")).dropDuplicates(["__k"])
                return failures(df.withColumn("__k", key).join(ref, "__k", "left"), url_audit(F.col(r.column), F.col("title"), F.col("__page"), kind), r.column)

            checks[f"{kind}_url_audit"] = audit_urls
    if pages is not None:
        checks["social_reference_reachable"] = lambda df, r: failures(reachable(df, pages, value_col=r.column, platform=r.platform), F.col("finding"), r.column)
    return checks


def wiki_key(c: Column) -> Column:
    return T.wiki_slug(c)
