"""Tables as users download them: fixed columns, one row per result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headers of the downloads, and the columns behind them.
EXPORTS = {
    "tv": {"Release Date": "release_date", "Title": "title", "IMDb ttcode": "imdb_id", "Network": "network", "Daypart": "daypart", "Program Type": "program_type", "Language Type": "language_type", "Genre 1": "genre_1", "Genre 2": "genre_2", "Genre 3": "genre_3"},
    "calendar": {"Section": "section", "Release Date": "release_date", "Title": "title", "URL": "url", "Provider": "provider", "Availability": "availability", "Details": "details", "Metascore": "metascore"},
    "box_office": {"Release Date": "release_date", "Title": "title", "URL": "url", "Distributor": "distributor", "Scale": "scale"},
    "chart": {"Rank": "rank", "Name": "name", "Last Week": "last_week", "Peak": "peak_position", "Weeks": "weeks_on_chart", "In Roster": "in_roster", "Roster Match": "roster_match", "Score": "score"},
}


def export_site_rows(queries: DataFrame, hits: DataFrame, *, query_id: str = "query_id") -> DataFrame:
    """One row per query and site: the best hit, the other addresses, and notes.

    ``queries`` has the id, title, year, title_type and ``notes`` (array); ``hits``
    the id, site, status, rank, url, result_title, score and ``notes`` (array of
    the site, equal on its rows; a site without a hit has one row without url).
    Sites of a query are few, so their addresses are gathered in one row.
    """
    ranked = F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("rank", "url", "result_title", "score"))))
    sites = hits.groupBy(query_id, "site").agg(F.max("status").alias("status"), ranked.alias("h"), F.max("notes").alias("site_notes"))
    first, rest = F.try_element_at("h", F.lit(1)), F.transform(F.slice("h", 2, 2**30), lambda x: x["url"])
    none = F.array().cast("array<string>")
    return queries.join(sites, query_id).select(
        query_id, F.col("title").alias("input_title"), F.col("year").alias("input_year"), F.col("title_type").alias("input_type"), "site", "status",
        F.coalesce(first["url"], F.lit("")).alias("url"), F.coalesce(first["result_title"], F.lit("")).alias("matched_title"), first["score"].alias("score"),
        F.array_join(rest, " | ").alias("alternates"), F.array_join(F.concat(F.coalesce("notes", none), F.coalesce("site_notes", none)), " | ").alias("notes"),
    )


def export_table(df: DataFrame, kind: str) -> DataFrame:
    """The columns of a download under their headers, as text; arrays joined by "; ", missing columns and nulls empty."""
    kinds = dict(df.dtypes)

    def shown(column: str) -> Column:
        if column not in kinds:
            return F.lit("")
        value = F.array_join(F.col(column).cast("array<string>"), "; ") if kinds[column].startswith("array") else F.col(column).cast("string")
        return F.coalesce(value, F.lit(""))

    return df.select(*[shown(column).alias(header) for header, column in EXPORTS[kind].items()])
