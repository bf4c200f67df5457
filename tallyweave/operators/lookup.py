"""Bulk look-up of names and ids in reference tables, with ranked matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# How a dataset title's kind counts in a scored look-up.
TYPE_WEIGHT = {"movie": 35, "tvMovie": 25, "tvSeries": 35, "tvMiniSeries": 30, "short": 8, "tvShort": 5, "video": 3, "tvSpecial": 4, "tvEpisode": -40, "podcastSeries": -55, "podcastEpisode": -65, "videoGame": -30}
MOVIE_KINDS, TV_KINDS = ["movie", "tvMovie"], ["tvSeries", "tvMiniSeries"]
# Release kinds by priority, and studios that count as major.
RELEASE_LABELS = [(3, "Wide"), (2, "Limited"), (4, "Digital"), (6, "TV"), (5, "Physical"), (1, "Premiere")]
RELEASE_DATE_ORDER = [3, 2, 1, 4, 5, 6]


def with_status(matches: DataFrame, query_id: str, order: list[Column], most: int = 25) -> DataFrame:
    """Rank the matches of each query; keep ``most``; add match_rank, total_matches and status.

    Rows without a match (null ``found``) keep rank and total null and status not_found.
    """
    w = Window.partitionBy(query_id, "found").orderBy(*order)
    ranked = matches.withColumn("match_rank", F.when(F.col("found").isNotNull(), F.row_number().over(w))).filter(F.col("match_rank").isNull() | (F.col("match_rank") <= most))
    total = F.count("match_rank").over(Window.partitionBy(query_id))
    counted = ranked.withColumn("total_matches", total)
    return counted.withColumn("status", F.when(F.col("total_matches") == 0, "not_found").when(F.col("total_matches") == 1, "matched").otherwise("multiple_matches"))


def lookup_ids(queries: DataFrame, reference: DataFrame, value_col: str, id_col: str) -> DataFrame:
    """Queries that hold a title or person id, joined with the reference: invalid, not_found or matched."""
    key = F.when(T.text(F.col(value_col)).rlike(T.ID_FORM), F.lower(T.text(F.col(value_col))))
    keyed = queries.withColumn("lookup_id", key)
    ref = reference.select(F.lower(F.col(id_col)).alias("lookup_id"), F.struct(*reference.columns).alias("match"))
    joined = keyed.join(ref, "lookup_id", "left")
    return joined.withColumn("status", F.when(F.col("lookup_id").isNull(), "invalid").when(F.col("match").isNull(), "not_found").otherwise("matched"))


def title_matches(queries: DataFrame, titles: DataFrame, *, query_id: str, query_norm: str, id_col: str, primary_norm: str, original_norm: str, carry: list[str]) -> DataFrame:
    """Titles whose primary or original normalised name equals a query's: (query_id, id, matched_on, carry...).

    Two equi-joins and a union, primary before original; a title matched by both
    counts as primary.  An OR condition would compare all pairs.
    """
    q = queries.select(query_id, F.col(query_norm).alias("__n")).filter("__n <> ''")
    by = lambda norm, rank, also: titles.select(id_col, *carry, F.col(norm).alias("__n"), F.lit(rank).alias("__by"), also.alias("__both"))
    primary = by(primary_norm, 0, F.lit(False))
    original = by(original_norm, 1, F.col(original_norm).eqNullSafe(F.col(primary_norm)))
    both = q.join(primary, "__n").unionByName(q.join(original.filter(~F.col("__both")), "__n"))
    return both.select(query_id, id_col, *carry, F.when(F.col("__by") == 0, "primary_title").otherwise("original_title").alias("matched_on"))


def lookup_titles(queries: DataFrame, titles: DataFrame, *, query_id: str, query_norm: str, id_col: str, primary_norm: str, original_norm: str, year_col: str, most: int = 25) -> DataFrame:
    """Exact normalised title look-up: primary matches first, then newest, then id; all queries are kept."""
    found = title_matches(queries, titles, query_id=query_id, query_norm=query_norm, id_col=id_col, primary_norm=primary_norm, original_norm=original_norm, carry=[year_col])
    joined = queries.select(query_id).join(found, query_id, "left").withColumn("found", F.when(F.col(id_col).isNotNull(), True))
    year = F.coalesce(F.col(year_col).cast("int"), F.lit(0))
    return with_status(joined, query_id, [F.col("matched_on").desc(), year.desc(), F.col(id_col)], most)


def lookup_people(queries: DataFrame, people: DataFrame, *, query_id: str, query_norm: str, id_col: str, name_norm: str, order: list[Column], most: int = 25) -> DataFrame:
    """Exact normalised name look-up in a given order; all queries are kept."""
    ref = people.withColumn("__n", F.col(name_norm)).filter("__n <> ''")
    joined = queries.select(query_id, F.col(query_norm).alias("__n")).join(ref, "__n", "left").drop("__n").withColumn("found", F.when(F.col(id_col).isNotNull(), True)).withColumn("matched_on", F.when(F.col("found"), "primary_name"))
    return with_status(joined, query_id, order, most)


def merge_auto(titles: DataFrame, people: DataFrame, query_id: str) -> DataFrame:
    """Title and person matches of one query ranked together, titles first.

    Both need (query_id, id, display_name, match_rank, status).  Successful rows
    are numbered anew and take their status from the new total; a query without
    any keeps one not_found row.
    """
    rows = titles.withColumn("kind", F.lit("title")).unionByName(people.withColumn("kind", F.lit("person")))
    good = F.col("match_rank").isNotNull()
    total = F.sum(good.cast("int")).over(Window.partitionBy(query_id))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(good.desc(), F.when(F.col("kind") == "title", 0).otherwise(1), "match_rank"))
    ranked = rows.withColumns({"total_matches": total, "__rank": rank}).filter(good | ((F.col("total_matches") == 0) & (F.col("__rank") == 1)))
    status = F.when(F.col("total_matches") == 0, "not_found").when(F.col("total_matches") == 1, "matched").otherwise("multiple_matches")
    via = F.concat(F.when(F.col("total_matches") > 1, "auto:").otherwise(""), "kind", F.lit("_to_id"))
    return ranked.withColumn("match_rank", F.when(good, F.col("__rank"))).withColumn("status", status).withColumn("resolved_lookup", F.when(F.col("total_matches") > 0, via)).drop("__rank")


def status_counts(rows: DataFrame, query_id: str) -> DataFrame:
    """Queries per status: of several the first of invalid, multiple_matches, matched, not_found."""
    worst = F.min(F.array_position(F.array(*[F.lit(s) for s in ("invalid", "multiple_matches", "matched", "not_found")]), F.col("status")))
    one = rows.groupBy(query_id).agg(worst.alias("w"))
    names = F.element_at(F.array(F.lit("invalid"), F.lit("multiple_matches"), F.lit("matched"), F.lit("not_found")), F.col("w").cast("int"))
    return one.groupBy(names.alias("status")).agg(F.count("*").alias("queries"))


def resolve_lists(rows: DataFrame, names: DataFrame, *, row_id: str, list_col: str, id_col: str, name_col: str, separator: str = "; ") -> DataFrame:
    """Comma lists of ids as lists of names, in order; unknown ids stay."""
    each = rows.select(row_id, F.posexplode(F.filter(F.transform(F.split(list_col, ","), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "__id"))
    joined = each.join(names.select(F.col(id_col).cast("string").alias("__id"), F.col(name_col).alias("__name")), "__id", "left")
    back = joined.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("__name", "__id").alias("name")))).alias("__all"))
    return back.select(row_id, F.array_join(F.transform("__all", lambda x: x["name"]), separator).alias("names"))


def match_score(matched_on: Column, kind: Column, want: Column, year: Column, want_year: Column, same_title: Column) -> Column:
    """Score of a dataset title for a query (title, kind movie/tv, year)."""
    weights = F.create_map(*[F.lit(x) for pair in TYPE_WEIGHT.items() for x in pair])
    movie, tv = kind.isin(MOVIE_KINDS), kind.isin(TV_KINDS)
    agree = (
        F.when((want == "movie") & movie, 28).when((want == "movie") & tv, -25).when((want == "movie") & kind.isin("podcastEpisode", "podcastSeries", "tvEpisode"), -60)
        .when((want == "tv") & tv, 28).when((want == "tv") & movie, -20).when((want == "tv") & kind.isin("podcastEpisode", "podcastSeries"), -60).otherwise(0)
    )
    near = F.when(want_year.isNotNull() & (year == want_year), 45).when(want_year.isNotNull() & year.isNotNull(), -F.least(F.abs(year - want_year) * 3, F.lit(24))).when(want_year.isNull() & year.isNotNull(), 4).otherwise(0)
    return (F.when(matched_on == "primary_title", 100).otherwise(92) + F.coalesce(F.try_element_at(weights, kind), F.lit(0)) + agree + near + F.when(same_title, 18).otherwise(0)).cast("double")


def title_forms(titles: DataFrame, *, id_col: str, primary_norm: str, original_norm: str, kind_col: str, year_col: str, most: int) -> DataFrame:
    """The titles that can be among the best ``most`` of any query: (norm, by_primary, kind, year, id).

    Titles of one name, kind and year score alike, so the first ids of each such
    group are enough; ranks are cut before the shuffle, and what is left of a very
    common name is bounded by its kinds and years.
    """
    form = lambda rows, norm: rows.select(F.col(norm).alias("norm"), F.lit(norm == primary_norm).alias("by_primary"), T.title_kind(F.col(kind_col)).alias("kind"), F.col(year_col).cast("int").alias("year"), F.col(id_col).alias("id"))
    own, other = form(titles, primary_norm), form(titles.filter(~F.col(original_norm).eqNullSafe(F.col(primary_norm))), original_norm)
    group = Window.partitionBy("norm", "by_primary", "kind", "year").orderBy("id")
    return own.unionByName(other).filter("norm <> ''").withColumn("turn", F.row_number().over(group)).filter(F.col("turn") <= most).drop("turn")


def best_titles(keys: DataFrame, titles: DataFrame, *, id_col: str, primary_norm: str, original_norm: str, kind_col: str, year_col: str, most: int) -> DataFrame:
    """The best ``most`` titles of each distinct (norm, want_kind, want_year): with id, matched_on, score and match_rank."""
    forms = title_forms(titles, id_col=id_col, primary_norm=primary_norm, original_norm=original_norm, kind_col=kind_col, year_col=year_col, most=most)
    met = keys.filter("norm <> ''").distinct().join(forms, "norm")
    matched_on = F.when(F.col("by_primary"), "primary_title").otherwise("original_title")
    score = match_score(matched_on, F.col("kind"), F.col("want_kind"), F.col("year"), F.col("want_year"), F.col("by_primary"))
    rank = F.row_number().over(Window.partitionBy("norm", "want_kind", "want_year").orderBy(F.desc("score"), F.coalesce("year", F.lit(0)).desc(), "id"))
    ranked = met.withColumns({"matched_on": matched_on, "score": score}).filter("score >= 0").withColumn("match_rank", rank)
    return ranked.filter(F.col("match_rank") <= most).select("norm", "want_kind", "want_year", "id", "matched_on", "score", "match_rank")


def scored_title_matches(queries: DataFrame, titles: DataFrame, *, query_id: str, query_norm: str, want_kind: str, want_year: str, id_col: str, primary_norm: str, original_norm: str, kind_col: str, year_col: str, most: int = 10) -> DataFrame:
    """The best ``most`` titles of each query by ``match_score``; negative scores are dropped.

    Order: score, newest year, id.  Every match is scored before the cut, once
    for queries of equal title, kind and year.
    """
    asked = queries.select(F.col(query_id).alias("asked"), F.col(query_norm).alias("norm"), F.col(want_kind).alias("want_kind"), F.col(want_year).cast("int").alias("want_year"))
    best = best_titles(asked.drop("asked"), titles, id_col=id_col, primary_norm=primary_norm, original_norm=original_norm, kind_col=kind_col, year_col=year_col, most=most)
    joined = asked.join(best.withColumnsRenamed({"want_kind": "k", "want_year": "y", "norm": "n"}), (F.col("norm") == F.col("n")) & F.col("want_kind").eqNullSafe(F.col("k")) & F.col("want_year").eqNullSafe(F.col("y")))
    return joined.select(F.col("asked").alias(query_id), F.col("id").alias(id_col), "matched_on", "score", "match_rank")


def match_status(matches: DataFrame, query_id: str, *, found: float = 150, gap: float = 8, uncertain: float = 110, found_with_year: float | None = None, year_match: Column | None = None) -> DataFrame:
    """One row per query: found, uncertain or not_found from its first and second scores."""
    best = matches.filter("match_rank <= 2").groupBy(query_id).agg(
        F.max(F.when(F.col("match_rank") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("match_rank") == 2, F.col("score"))).alias("next"),
        F.bool_or(F.coalesce(year_match, F.lit(False)) & (F.col("match_rank") == 1) if year_match is not None else F.lit(False)).alias("year"),
    )
    clear = (F.col("score") >= found) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= gap))
    also = (F.col("score") >= found_with_year) & F.col("year") if found_with_year is not None else F.lit(False)
    return best.select(query_id, "score", F.when(clear | also, "found").when(F.col("score") >= uncertain, "uncertain").otherwise("not_found").alias("status"))


def attach_ids(items: DataFrame, scored: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Items with the best match of their (title, kind, year), looked up once per distinct key."""
    return items.join(scored.filter("match_rank = 1").select(*keys, id_col), keys, "left")


def episode_counts(episodes: DataFrame, *, parent: str, season: str) -> DataFrame:
    """Per parent: seasons, latest season, its episodes, all episodes; null and non-positive seasons count in the last only."""
    each = episodes.groupBy(F.col(parent).alias("parent"), F.when(F.col(season) > 0, F.col(season)).alias("season")).agg(F.count("*").alias("n"))
    return each.groupBy("parent").agg(
        F.count("season").alias("season_count"), F.max("season").alias("latest_season_number"),
        F.max_by("n", "season").alias("latest_season_episode_count"), F.sum("n").alias("episode_count"),
    )


def season_windows(episodes: DataFrame, *, parent: str, season: str, date: str, fallback: Column | None = None, days: int = 30) -> DataFrame:
    """Start and end of each parent's latest season; one episode or date makes the end ``days`` later."""
    w = Window.partitionBy(parent)
    latest = episodes.withColumn("__latest", F.max(season).over(w)).filter(F.col(season) == F.col("__latest"))
    found = latest.groupBy(parent).agg(F.min(date).alias("start"), F.max(date).alias("last"), F.count(date).alias("episodes"))
    start = F.coalesce("start", fallback) if fallback is not None else F.col("start")
    end = F.when((F.col("episodes") <= 1) | (F.col("start") == F.col("last")), F.date_add(start, days)).otherwise(F.col("last"))
    return found.select(parent, start.alias("start_date"), end.alias("end_date"), "episodes")


def release_labels(releases: DataFrame, *, key: str, type_col: str, date_col: str) -> DataFrame:
    """Per title: the release kind of highest priority and the preferred date."""
    order = F.create_map(*[F.lit(x) for i, (t, _) in enumerate(RELEASE_LABELS) for x in (t, i)])
    names = F.create_map(*[F.lit(x) for i, (_, label) in enumerate(RELEASE_LABELS) for x in (i, label)])
    dates = F.create_map(*[F.lit(x) for i, t in enumerate(RELEASE_DATE_ORDER) for x in (t, i)])
    t = F.col(type_col).cast("int")
    got = releases.groupBy(key).agg(
        F.min(F.try_element_at(order, t)).alias("p"),
        F.min(F.when(F.col(date_col).isNotNull(), F.struct(F.coalesce(F.try_element_at(dates, t), F.lit(6)).alias("p"), F.col(date_col).alias("d")))).alias("d"),
    )
    return got.select(key, F.coalesce(F.try_element_at(names, F.col("p")), F.lit("")).alias("release_type"), F.col("d.d").alias("release_date"))


def verify_metadata(claims: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Discrepancies of claimed against actual (title, year, network, genres): key, field, severity.

    Unknown ids give one row "id".  Titles compare normalised; a network agrees
    if either holds the other; genres if one is common.  Blank claims make none.
    """
    a = actual.select(F.col(key).alias("__k"), *[F.col(c).alias(f"a_{c}") for c in ("title", "year", "network", "genres")])
    j = claims.join(a, claims[key] == a["__k"], "left")
    known = F.col("__k").isNotNull()
    net, other = F.lower(T.text(F.col("network"))), F.lower(T.text(F.col("a_network")))
    tests = [
        ("id", "high", ~known),
        ("title", "high", known & (T.norm_lookup(F.col("title")) != "") & (T.norm_lookup(F.col("title")) != T.norm_lookup(F.col("a_title")))),
        ("year", "medium", known & F.col("year").isNotNull() & F.col("a_year").isNotNull() & (F.col("year") != F.col("a_year"))),
        ("network", "medium", known & (net != "") & (other != "") & ~net.contains(other) & ~other.contains(net)),
        ("genres", "low", known & (F.size(F.coalesce("genres", F.array())) > 0) & (F.size(F.coalesce("a_genres", F.array())) > 0) & ~F.arrays_overlap(F.transform("genres", T.genre), F.transform("a_genres", T.genre))),
    ]
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(f).alias("field"), F.lit(s).alias("severity"))) for f, s, test in tests]), lambda x: x.isNotNull())
    return j.select(claims[key], F.inline(found))


def assemble(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Two sources by key; of each field the first that isn't blank."""
    x, y = a.select(key, *[F.col(f).alias(f"x_{f}") for f in fields]), b.select(key, *[F.col(f).alias(f"y_{f}") for f in fields])
    pick = lambda f: F.coalesce(F.when(~T.is_blank(F.col(f"x_{f}")), F.col(f"x_{f}")), F.col(f"y_{f}"))
    return x.join(y, key, "full_outer").select(key, *[pick(f).alias(f) for f in fields])


def select_result(results: DataFrame, *, query_id: str, query_norm: str, title_norm: str, order: list[Column], year_match: Column | None = None, require_year: bool = False) -> DataFrame:
    """Per query the loosely matching result: those of the right year if there are any, exact before loose, then ``order``."""
    loose = results.filter(T.loosely_equal(F.col(query_norm), F.col(title_norm)))
    year = F.coalesce(year_match, F.lit(False)) if year_match is not None else F.lit(True)
    loose = loose.withColumn("__year", year)
    if require_year:
        loose = loose.filter("__year")
    exact = (F.col(query_norm) == F.col(title_norm)).cast("int")
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("__year").desc(), exact.desc(), *order))
    return loose.withColumn("__rank", rank).filter("__rank = 1").drop("__rank", "__year")


def query_variants(title: Column) -> Column:
    """Spellings of a title to search for: as it is, without brackets, with & and and exchanged, without " - DAR"."""
    bare = F.regexp_replace(title, r"(?i)\s+-\s+dar\z", "")
    forms = [bare, F.regexp_replace(bare, r"\s*\([^)]*\)\s*\z", ""), F.regexp_replace(bare, "&", "and"), F.regexp_replace(bare, r"(?i)\band\b", "&")]
    return F.array_distinct(F.filter(F.array(*[T.squeeze(f) for f in forms]), lambda x: x != ""))


def professions(c: Column) -> Column:
    """Comma list of professions for display."""
    return F.array_join(F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: F.initcap(F.regexp_replace(F.trim(x), "_", " "))), "; ")


def fresh_reference(cached: DataFrame, live: DataFrame, key: str, now: Column, days: int) -> DataFrame:
    """Cached rows while fresh, else live rows; a stale success is better than a new failure.

    Both have ``ok`` and ``checked_at`` beside the key and their columns.
    """
    columns = [c for c in cached.columns if c != key]
    c, n = cached.select(key, F.struct(*columns).alias("c")), live.select(key, F.struct(*columns).alias("n"))
    fresh = F.col("c").isNotNull() & (F.col("c.checked_at") >= now - F.expr(f"INTERVAL {days} DAYS"))
    stale_ok = F.col("c").isNotNull() & F.col("c.ok") & ~F.coalesce(F.col("n.ok"), F.lit(False))
    pick = F.when(fresh | stale_ok, F.col("c")).otherwise(F.coalesce("n", "c"))
    return c.join(n, key, "full_outer").select(key, pick.alias("r")).select(key, "r.*")


def bulk_enrich(rows: DataFrame, titles: DataFrame, *, row_col: str, title: str, year: str, category: str, id_col: str, primary_norm: str, original_norm: str, kind_col: str, year_col: str, carry: dict[str, str]) -> DataFrame:
    """Rows with the best match of their title: ``enriched_`` columns and ``enrich_status``.

    The year is the first four digits of its column; the category says movie or
    tv. ``carry`` maps enriched names to columns of ``titles``. Status: not_found,
    matched, or multiple where the two best scores are equal. Each distinct (title,
    kind, year) is looked up once; rows take its match by that key (``row_col`` may repeat).
    """
    kind = F.lower(F.coalesce(F.col(category).cast("string"), F.lit("")))
    key = {
        "norm": T.norm_lookup(F.col(title)), "want_kind": F.when(kind.contains("movie"), "movie").when(kind.contains("tv"), "tv").otherwise("any"),
        "want_year": F.regexp_extract(F.coalesce(F.col(year).cast("string"), F.lit("")), r"\b(\d{4})\b", 1).try_cast("int"),
    }
    found = best_titles(rows.select(*[c.alias(n) for n, c in key.items()]), titles, id_col=id_col, primary_norm=primary_norm, original_norm=original_norm, kind_col=kind_col, year_col=year_col, most=2)
    best = found.groupBy("norm", "want_kind", "want_year").agg(F.min_by("id", "match_rank").alias("id"), F.max("score").alias("score"), F.count_if(F.col("match_rank") == 2).alias("more"), F.min("score").alias("low"))
    known = titles.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"enriched_{n}") for n, c in carry.items()])
    best = best.join(known, "id").select(F.struct("norm", "want_kind", F.coalesce("want_year", F.lit(-1)).alias("want_year")).alias("__key"), "id", "score", "more", "low", *[f"enriched_{n}" for n in carry])
    status = F.when(F.col("id").isNull(), "not_found").when((F.col("more") > 0) & (F.col("low") == F.col("score")), "multiple").otherwise("matched")
    asked = F.struct(key["norm"].alias("norm"), key["want_kind"].alias("want_kind"), F.coalesce(key["want_year"], F.lit(-1)).alias("want_year"))
    joined = rows.select(F.struct(*rows.columns).alias("__row"), asked.alias("__key")).join(best, "__key", "left")
    return joined.select(*[F.col("__row").getField(c).alias(c) for c in rows.columns], F.col("id").alias("enriched_id"), *[f"enriched_{n}" for n in carry], status.alias("enrich_status"))
