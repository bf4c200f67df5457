"""Column profiles, outliers, rare values, and health scores of rows and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What counts as missing in a profile.
MISSING = ["", "\\n", "nan", "null"]
# How much each field counts for completeness.
FIELD_WEIGHTS = {"title": 1.0, "TV Show/Movie": 1.0, "primary_genre": 0.8, "genre": 0.8, "released_on": 0.8, "imdb_id": 1.0, "wikipedia_url": 0.7, "network": 0.6, "platform": 0.6}


def unpivoted(df: DataFrame, columns: list[str], row_col: str | None = None) -> DataFrame:
    """(row_id,) column, value: one row per cell, in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(*([F.col(row_col).alias("row_id")] if row_col else []), F.inline(cells))


def column_health(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: share of missing cells in percent (2 decimals) and number of distinct values.

    Cells are counted per value before anything is counted distinct, so a column
    with few values costs a few rows of shuffle.
    """
    value = T.norm_value(F.col("value"))
    filled = F.when(~value.isin(MISSING), value)
    cells = unpivoted(df, columns or df.columns).select("column", filled.alias("v"))
    if approximate:
        return cells.groupBy("column").agg(F.round(F.avg(F.col("v").isNull().cast("int")) * 100, 2).alias("missing_pct"), F.approx_count_distinct("v").alias("cardinality"))
    counts = cells.groupBy("column", "v").agg(F.count("*").alias("n"))
    missing = F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0))
    return counts.groupBy("column").agg(F.round(missing / F.sum("n") * 100, 2).alias("missing_pct"), F.count("v").alias("cardinality"))


def _year_counts(cells: DataFrame) -> DataFrame:
    return cells.withColumn("year", T.first_year(F.col("value"))).filter("year IS NOT NULL")


def date_outliers(df: DataFrame, columns: list[str], row_col: str = "row_id") -> DataFrame:
    """Cells whose first year lies outside 1.5 interquartile ranges of their column.

    Quartiles are the values at index floor(n/4) and floor(3n/4) of the sorted
    years, found on counts per year.  Columns with fewer than four years have none.
    """
    cells = _year_counts(unpivoted(df, columns, row_col))
    counts = cells.groupBy("column", "year").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("column").orderBy("year"))
    total = F.sum("n").over(Window.partitionBy("column"))
    placed = counts.withColumns({"upto": upto, "total": total})
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), F.col("year")))
    bounds = placed.groupBy("column").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("total").alias("total")).filter("total >= 4")
    bounds = bounds.select("column", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"))
    out = cells.join(F.broadcast(bounds), "column").filter("year < low OR year > high")
    past = F.when(F.col("year") > F.col("high"), F.col("year") - F.col("high")).otherwise(F.col("low") - F.col("year"))
    return out.select("row_id", "column", "value", F.lit("date_outlier").alias("anomaly_type"), F.when(past > 10, "high").otherwise("medium").alias("severity"))


def rare_categories(df: DataFrame, columns: list[str], row_col: str = "row_id", min_frequency: float = 0.02, most: int = 2, least_rows: int = 10) -> DataFrame:
    """Cells whose value makes up less than ``min_frequency`` of a column's filled cells and occurs at most ``most`` times."""
    cells = unpivoted(df, columns, row_col).withColumn("v", T.norm_value(F.col("value")))
    counts = cells.groupBy("column", "v").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("column")
    counts = counts.withColumns({"rows": F.sum("n").over(whole), "filled": F.sum(F.when(F.col("v") != "", F.col("n"))).over(whole)})
    rare = counts.filter((F.col("v") != "") & (F.col("rows") >= least_rows) & (F.col("n") / F.col("filled") < min_frequency) & (F.col("n") <= most))
    return cells.join(rare.select("column", "v"), ["column", "v"]).select("row_id", "column", F.regexp_replace("value", T.EDGES, "").alias("value"), F.lit("rare_category").alias("anomaly_type"), F.lit("low").alias("severity"))


def detect_all(df: DataFrame, row_col: str = "row_id", date_columns: list[str] | None = None, categorical_columns: list[str] | None = None) -> DataFrame:
    """Date outliers and rare categories of the columns whose names suggest them."""
    named = lambda *words: [c for c in df.columns if any(w in c.casefold() for w in words)]
    dates, kinds = date_columns or named("date", "released"), categorical_columns or named("genre", "category", "network")
    parts = ([date_outliers(df, dates, row_col)] if dates else []) + ([rare_categories(df, kinds, row_col)] if kinds else [])
    if not parts:
        return df.sparkSession.createDataFrame([], "row_id long, column string, value string, anomaly_type string, severity string")
    return reduce(DataFrame.unionByName, parts)


def column_report(df: DataFrame, anomalies: DataFrame) -> DataFrame:
    """``column_health`` with the number of anomalies of each column."""
    counts = anomalies.groupBy("column").agg(F.count("*").alias("anomalies_count"))
    return column_health(df).join(F.broadcast(counts), "column", "left").fillna(0, ["anomalies_count"])


def _score(passed: list[Column], checked: list[Column]) -> Column:
    """Percent of the checks made that passed; 100 if none was made."""
    if not checked:
        return F.lit(100.0)
    total = reduce(lambda a, b: a + b, [c.cast("double") for c in checked])
    good = reduce(lambda a, b: a + b, [(c & p).cast("double") for c, p in zip(checked, passed, strict=True)])
    return F.when(total > 0, good / total * 100.0).otherwise(100.0)


def row_health(df: DataFrame, weights: dict[str, float] | None = None, strict_header_roles: bool = False) -> DataFrame:
    """Adds ``health``: completeness, format_score, consistency, uniqueness, overall_score, grade, issues.

    Which checks apply follows from the column names.  All in one projection.
    ``strict_header_roles`` checks a column named for both a URL and an id as a URL only.
    """
    names = df.columns
    having = lambda *words: [c for c in names if any(w in c.casefold() for w in words)]
    cell = lambda c: T.text(F.col(f"`{c}`"))
    issues: list[Column] = []

    def issue(test: Column, code: str, column: str, message: Column | str):
        said = F.lit(message) if isinstance(message, str) else message
        issues.append(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(column).alias("column"), said.alias("message"))))

    own = {c.casefold(): c for c in names}
    fields = [(own[w.casefold()], x) for w, x in (weights or FIELD_WEIGHTS).items() if w.casefold() in own]
    filled = [(c, x, ~F.lower(cell(c)).isin("", "\\n", "nan")) for c, x in fields]
    for c, _, full in filled:
        issue(~full, "missing", c, f"Missing required field: '{c}'")
    got = reduce(lambda a, b: a + b, [F.when(full, F.lit(float(x))).otherwise(0.0) for _, x, full in filled], F.lit(0.0))
    completeness = got / sum(x for _, x in fields) * 100.0 if fields else F.lit(100.0)

    passed, checked = [], []
    urls = having("url", "link")
    for kind, columns, test in (
        ("URL", urls, T.valid_url), ("IMDb ID", [c for c in having("imdb") if not (strict_header_roles and c in urls)], T.valid_title_id), ("date", having("date", "released"), T.valid_date_shape),
    ):
        for c in columns:
            checked.append(cell(c) != "")
            passed.append(test(cell(c)))
            issue((cell(c) != "") & ~test(cell(c)), "format", c, F.concat(F.lit(f"Invalid {kind} format in '{c}': "), cell(c)))
    formats = _score(passed, checked)

    passed, checked = [], []
    years, released = having("year"), having("released", "street")
    if years and released:
        y, r = cell(years[0]), cell(released[0])
        checked.append((y != "") & (F.length(r) >= 4))
        passed.append(r.contains(y))
        issue((y != "") & (F.length(r) >= 4) & ~r.contains(y), "year", years[0], F.concat(F.lit("Year '"), y, F.lit("' does not match release date year in '"), r, F.lit("'")))
    for c in having("genre"):
        odd = cell(c).contains("\n") | cell(c).contains("   ")
        checked.append(cell(c) != "")
        passed.append(~odd)
        issue((cell(c) != "") & odd, "formatting", c, f"Formatting placeholder issues found in genre field: '{c}'")
    theatrical, digital, trailer = having("theatrical", "release_date"), having("digital", "vod", "streaming"), having("trailer_release", "trailer_date")
    iso = lambda c: cell(c).rlike(r"^\d{4}-\d{2}-\d{2}\z")
    for other, before, says in ((digital, True, "Theatrical date is after Digital date"), (trailer, False, "Trailer date is after Theatrical date")):
        if theatrical and other:
            a, b = theatrical[0], other[0]
            good = cell(a) <= cell(b) if before else cell(b) <= cell(a)
            checked.append(iso(a) & iso(b))
            passed.append(good)
            issue(iso(a) & iso(b) & ~good, "order", b, f"{says}: '{a}', '{b}'")
    consistency = _score(passed, checked)
    overall = completeness * 0.35 + formats * 0.25 + consistency * 0.20 + F.lit(20.0)
    found = F.filter(F.array(*issues), lambda x: x.isNotNull()) if issues else F.array().cast("array<struct<code:string,column:string,message:string>>")
    return df.withColumn("health", F.struct(
        F.round(completeness, 2).alias("completeness"), F.round(formats, 2).alias("format_score"), F.round(consistency, 2).alias("consistency"), F.lit(100.0).alias("uniqueness"),
        F.round(overall, 2).alias("overall_score"), T.grade(overall).alias("grade"), found.alias("issues"),
    ))


def id_columns(names: list[str]) -> list[str]:
    low = {c: c.casefold() for c in names}
    return [c for c, n in low.items() if n == "id" or n.endswith(("_id", " id", "-id")) or "imdb" in n or "tmdb" in n]


def row_health_in_table(df: DataFrame, row_col: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``row_health``, with uniqueness 50 for rows that share an identifier with another row.

    Identifiers of all columns are counted in one shuffle.
    """
    ids = [c for c in id_columns(df.columns) if c != row_col]
    scored = row_health(df, weights)
    if not ids:
        return scored
    cells = unpivoted(df, ids, row_col).withColumn("v", T.text(F.col("value"))).filter("v <> ''")
    often = cells.groupBy("column", "v").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = cells.join(often, ["column", "v"]).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(F.lit("duplicate").alias("code"), "column", F.concat(F.lit("Duplicate identifier found in '"), "column", F.lit("': '"), "v", F.lit("'")).alias("message")))).alias("__repeated")).withColumnRenamed("row_id", "__row")
    h = F.col("health")
    lower = F.round(h["completeness"] * 0.35 + h["format_score"] * 0.25 + h["consistency"] * 0.20 + 10.0, 2)
    joined = scored.join(repeated, F.col(row_col) == F.col("__row"), "left").drop("__row")
    changed = h.withField("uniqueness", F.lit(50.0)).withField("overall_score", lower).withField("grade", T.grade(lower)).withField("issues", F.concat(h["issues"], "__repeated"))
    return joined.withColumn("health", F.when(F.col("__repeated").isNotNull(), changed).otherwise(h)).drop("__repeated")


def table_health(rows: DataFrame) -> DataFrame:
    """One row: averages, overall score, grade and grade distribution of ``row_health_in_table``."""
    mean = {c: F.avg(f"health.{c}") for c in ("completeness", "format_score", "consistency", "uniqueness")}
    grades = F.map_from_arrays(F.array(*[F.lit(g) for g in "ABCDF"]), F.array(*[F.count_if(F.col("health.grade") == g) for g in "ABCDF"]))
    got = rows.agg(F.count("*").alias("rows"), *[v.alias(c) for c, v in mean.items()], grades.alias("grades"))
    overall = F.col("completeness") * 0.35 + F.col("format_score") * 0.25 + F.col("consistency") * 0.20 + F.col("uniqueness") * 0.20
    overall = F.coalesce(overall, F.lit(0.0))
    return got.select("rows", *[F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in mean], F.round(overall, 2).alias("overall_score"), T.grade(overall).alias("grade"), "grades")


def worst_columns(rows: DataFrame, k: int = 3) -> DataFrame:
    """The columns with most issues."""
    issues = rows.select(F.inline("health.issues"))
    return issues.groupBy("column").agg(F.count("*").alias("issues")).orderBy(F.desc("issues"), "column").limit(k)
