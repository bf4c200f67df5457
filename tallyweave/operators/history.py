"""Runs, activity, date windows and exports."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

# Days before and after the anchor of each window.
WINDOWS = {"today": (0, 0), "last_7_days": (-6, 0), "week": (0, 7), "month": (0, 30), "year": (0, 365)}


def run_history(runs: DataFrame, at: str, limit: int) -> DataFrame:
    """The newest runs; the limit is what is asked for."""
    return runs.orderBy(F.desc(at), *[c for c in runs.columns if c != at]).limit(limit)


def dashboard(runs: DataFrame, *, at: str, issues: str, today: Column, newest: int = 500) -> DataFrame:
    """Totals over the newest runs."""
    recent = run_history(runs, at, newest)
    return recent.agg(
        F.count("*").alias("total"), F.count_if(F.to_date(at) == today).alias("today"), F.count_if(F.col(issues) == 0).alias("clean"),
        F.count_if(F.col(issues) != 0).alias("flagged"), F.coalesce(F.sum(issues), F.lit(0)).alias("issues"),
    )


def activity(sources: list[tuple[str, DataFrame]], limit: int = 12) -> DataFrame:
    """The newest events of several sources (at, subject, actor), each with its kind."""
    parts = [df.select(F.lit(kind).alias("kind"), "at", "subject", "actor").orderBy(F.desc("at"), "subject", "actor").limit(limit) for kind, df in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("at"), "kind", "subject", "actor").limit(limit)


def date_window(key: str, today: datetime.date, start: datetime.date | None = None, end: datetime.date | None = None) -> tuple[datetime.date, datetime.date]:
    """First and last day of a named window; on Mondays the daily one starts on Saturday."""
    day = datetime.timedelta(days=1)
    if key == "custom":
        if start is None or end is None or start > end:
            raise ValueError("a custom window needs a start on or before its end")
        return start, end
    if key == "daily_segment":
        return (today - 2 * day if today.weekday() == 0 else today), today
    if key == "box_office_last_7":
        return today - 7 * day, today - day
    if key not in WINDOWS:
        raise ValueError(f"unknown window: {key}")
    before, after = WINDOWS[key]
    return today + before * day, today + after * day


def month_window(today: Column, months: int) -> tuple[Column, Column]:
    """From today to the same day some months on, or that month's last day."""
    return today, F.add_months(today, months)


def monthly_anchors(first: Column, last: Column) -> Column:
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))


def window_flags(items: DataFrame, date: Column, start: datetime.date, end: datetime.date, skip: dict[str, Column] | None = None) -> DataFrame:
    """Add ``window_flag``: the first reason to skip an item, no_date, outside, or kept."""
    flag = F.coalesce(*[F.when(test, name) for name, test in (skip or {}).items()], F.when(date.isNull(), "no_date"), F.when(~date.between(F.lit(start), F.lit(end)), "outside"), F.lit("kept"))
    return items.withColumn("window_flag", flag)


def window_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("window_flag").agg(F.count("*").alias("items"))


def observed_window(items: DataFrame, date: Column, start: datetime.date, end: datetime.date, skip: dict[str, Column] | None = None, name: str = "window") -> tuple[DataFrame, Observation | None]:
    """The items of a window and an observation of how many were kept and skipped, by reason.

    The counters are filled by whatever action reads the items, in the same
    pass.  On a stream they are in each batch's progress, as ``observedMetrics[name]``,
    and the observation is None.
    """
    flagged = window_flags(items, date, start, end, skip)
    counters = [F.count_if(F.col("window_flag") == flag).alias(flag) for flag in [*(skip or {}), "no_date", "outside", "kept"]]
    watch = None if items.isStreaming else Observation(name)
    return flagged.observe(watch or name, *counters).filter("window_flag = 'kept'").drop("window_flag"), watch


def release_report(items: DataFrame, start: datetime.date, end: datetime.date, *, date: str, title: str, keys: list[str]) -> DataFrame:
    """Items of a window, the first of equal keys, in order of date and title."""
    kept = window_flags(items, F.col(date), start, end).filter("window_flag = 'kept'").drop("window_flag")
    low = [F.lower(F.col(k).cast("string")) for k in keys]
    named = kept.select("*", *[c.alias(f"__k{i}") for i, c in enumerate(low)])
    turn = F.row_number().over(Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy(date, title))
    return named.withColumn("__turn", turn).filter("__turn = 1").select(*items.columns).orderBy(date, F.lower(title))


def weekly_append(existing: DataFrame, new: DataFrame, run_col: str, run: str) -> DataFrame:
    """The table with the rows of a run replaced by new ones; rows without a run stay."""
    return existing.filter(F.col(run_col).isNull() | (F.col(run_col) != run)).unionByName(new.withColumn(run_col, F.lit(run)), allowMissingColumns=True)


def export_matrix(profiles: DataFrame, *, keys: list[str], platforms: list[str], least: float = 60) -> DataFrame:
    """One row per entity and a column per platform: "name | @handle | score/label | url" from ``least`` on."""
    cell = F.when(F.col("score") >= least, F.concat_ws(" | ", "display_name", F.concat(F.lit("@"), F.col("handle")), F.concat_ws("/", F.col("score").cast("string"), "label"), "url"))
    status = F.array_position(F.array(*[F.lit(s) for s in ("not_found", "uncertain", "ambiguous", "found")]), F.col("status"))
    top = profiles.groupBy(*keys).agg(F.max_by("status", status).alias("status"))
    wide = profiles.withColumn("cell", cell).groupBy(*keys).pivot("platform", platforms).agg(F.max_by("cell", F.struct("score", "url")))
    return wide.join(top, keys)


def export_rows(df: DataFrame, columns: list[str], separators: dict[str, str] | None = None) -> DataFrame:
    """A fixed list of columns as text; arrays joined, missing columns empty."""
    kinds = dict(df.dtypes)

    def shown(c: str) -> Column:
        if c not in kinds:
            return F.lit("").alias(c)
        value = F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), (separators or {}).get(c, ", ")) if kinds[c].startswith("array") else F.col(c).cast("string")
        return F.coalesce(value, F.lit("")).alias(c)

    return df.select(*[shown(c) for c in columns])
