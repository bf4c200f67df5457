"""Metadata of titles put together from nested source records: names, releases and videos by title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lookup import release_labels

#: Kinds of entries in the table of names.
NAME_KINDS = ("genre", "company", "network")


def iso_date(c: Column) -> Column:
    """The first ten characters of a date text if they are a date, else null."""
    day = F.substring(T.text(c), 1, 10)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day)


def filled(*columns: Column) -> Column:
    """The first value that is neither null, empty nor zero, as text; else the empty text."""
    return F.coalesce(*[F.when(~F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0"), c.cast("string")) for c in columns], F.lit(""))


def ordered_names(names: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """(key, genre, company, network): the names of each kind in the order of ``pos``, at most ``most`` of each."""
    held = names.filter(~T.is_blank(F.col("name")))
    lists = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "name")))).alias(k) for k in NAME_KINDS]
    plain = lambda k: F.transform(F.col(k) if most is None else F.slice(k, 1, most), lambda x: x["name"]).alias(k)
    return held.groupBy(key).agg(*lists).select(key, *[plain(k) for k in NAME_KINDS])


def movie_reference(details: DataFrame, releases: DataFrame, names: DataFrame, *, key: str = "id", most: int | None = None) -> DataFrame:
    """Reference records of titles, as the movie and genre checks take them.

    ``details``: key, kind (movie or tv), title, original_title, release_date;
    ``releases``: key, country, type, date; ``names``: key, kind (genre, company,
    network), pos, name.  A movie's date is that of its US releases (by kind of release, then the
    earliest), else its general one; ``release_date_source`` says which.  Companies
    are given for movies, networks for shows; ``most`` cuts the lists of names.
    Adds ``title_norm`` and ``year``, by which tables of titles are joined.
    """
    us = releases.filter(F.upper("country") == "US").select(key, F.col("type").cast("int").alias("type"), iso_date(F.col("date")).alias("date"))
    labels = release_labels(us, key=key, type_col="type", date_col="date").withColumnRenamed("release_date", "us_date")
    joined = details.join(labels, key, "left").join(ordered_names(names, key, most), key, "left")
    movie, none = F.col("kind") == "movie", F.array().cast("array<string>")
    general = iso_date(F.col("release_date"))
    us_date = F.when(movie, F.col("us_date"))
    lists = {"genres": F.col("genre"), "companies": F.when(movie, F.col("company")), "networks": F.when(~movie, F.col("network"))}
    made = joined.select(
        key, F.when(movie, "movie").otherwise("tvSeries").alias("type"), filled(F.col("title"), F.col("original_title")).alias("title"), us_date.alias("us_date"), general.alias("general_date"),
        F.coalesce(us_date, general).alias("release_date"), F.when(us_date.isNotNull(), "US").when(general.isNotNull(), "global").otherwise("").alias("release_date_source"),
        F.when(movie, F.coalesce("release_type", F.lit(""))).otherwise("").alias("release_type"), *[F.coalesce(c, none).alias(n) for n, c in lists.items()],
    )
    return made.withColumns({"title_norm": T.norm_title(F.col("title")), "year": F.coalesce(F.substring("release_date", 1, 4).cast("int"), F.lit(0))})


def release_windows(releases: DataFrame, key: str) -> DataFrame:
    """(key, theatrical, digital): of the US releases of type 3 and 4 the last entry's date, in the order of ``pos``."""
    day = F.substring(F.coalesce("date", F.lit("")), 1, 10)
    last = lambda kind: F.max_by(F.when(F.col("type") == kind, day), F.when(F.col("type") == kind, F.col("pos")))
    return releases.filter(F.upper("country") == "US").groupBy(key).agg(last(3).alias("theatrical"), last(4).alias("digital"))


def trailers(videos: DataFrame, key: str) -> DataFrame:
    """(key, trailer_url, trailer_date): the first official trailer on the video site, else the last one."""
    trailer = F.struct(F.concat(F.lit("https://www.youtube.com/watch?v="), "video").alias("url"), F.substring(F.coalesce("published_at", F.lit("")), 1, 10).alias("date"))
    official = F.coalesce("official", F.lit(False))
    first = F.min_by(F.when(official, trailer), F.when(official, F.col("pos")))
    found = videos.filter("type = 'Trailer' AND site = 'YouTube'").groupBy(key).agg(F.coalesce(first, F.max_by(trailer, "pos")).alias("t"))
    return found.select(key, F.col("t.url").alias("trailer_url"), F.col("t.date").alias("trailer_date"))


def assemble_metadata(primary: DataFrame, secondary: DataFrame, *, releases: DataFrame, videos: DataFrame, names: DataFrame, key: str = "id") -> DataFrame:
    """One record per title from two sources; of each field the first that is filled.

    ``primary``: key, media_type, title, original_title, release_date,
    first_air_date, last_air_date, runtime, episode_run_time (array), vote_average, vote_count,
    overview, poster_path, status; ``secondary``: key, title, type, year, runtime,
    rating, votes, plot, poster, genre (comma list), director, writer, actors.
    ``releases`` (with pos) give the US cinema and digital dates, ``videos``
    (key, pos, type, site, video, official, published_at) the trailer, ``names`` the
    genres and networks.  Missing fields are empty.
    """
    named = lambda df, prefix: df.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])
    joined = named(primary, "p").withColumn("p_in", F.lit(True)).join(named(secondary, "s"), key, "full_outer")
    for part in (release_windows(releases, key), trailers(videos, key), ordered_names(names, key).select(key, "genre", "network")):
        joined = joined.join(part, key, "left")
    c = F.col
    listed = F.filter(F.transform(F.split(F.coalesce("s_genre", F.lit("")), ","), lambda g: F.trim(g)), lambda g: g != "")
    own = c("p_in").isNotNull()  # lists by title belong to the primary source
    mine = lambda column: F.when(own, column)
    poster = F.when(filled(c("p_poster_path")) != "", F.concat(F.lit("https://image.tmdb.org/t/p/w500"), "p_poster_path"))
    movie = F.coalesce((c("p_media_type") == "movie") | (c("s_type") == "movie"), c("p_media_type") == "movie", c("s_type") == "movie", F.lit(False))
    return joined.select(
        key, filled(c("p_title"), c("s_title")).alias("title"), filled(c("p_original_title"), c("s_title")).alias("original_title"), F.when(movie, "movie").otherwise("tvSeries").alias("title_type"),
        F.substring(filled(c("p_release_date"), c("p_first_air_date"), c("s_year")), 1, 4).alias("year"), F.substring(filled(c("p_last_air_date")), 1, 4).alias("end_year"),
        filled(c("p_runtime"), F.try_element_at("p_episode_run_time", F.lit(1)), c("s_runtime")).alias("runtime_minutes"), F.when(F.size(F.coalesce(mine(c("genre")), F.array())) > 0, c("genre")).otherwise(listed).alias("genres"),
        filled(c("p_vote_average"), c("s_rating")).alias("rating"), filled(c("p_vote_count"), c("s_votes")).alias("votes"), filled(c("p_overview"), c("s_plot")).alias("plot"), filled(poster, c("s_poster")).alias("poster_url"),
        filled(c("s_director")).alias("directors"), filled(c("s_writer")).alias("writers"), filled(c("s_actors")).alias("cast"), F.array_join(F.coalesce(mine(c("network")), F.array().cast("array<string>")), ", ").alias("networks"), filled(c("p_status")).alias("status"),
        F.coalesce(mine(c("theatrical")), filled(c("p_release_date"))).alias("theatrical_release_date"), F.coalesce(mine(c("digital")), F.lit("")).alias("digital_release_date"),
        F.coalesce(mine(c("trailer_url")), F.lit("")).alias("trailer_url"), F.coalesce(mine(c("trailer_date")), F.lit("")).alias("trailer_release_date"),
    )
