"""Usual chains of operators, as plain functions on lazy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import compare, duplicates, profile, rules
from .lookup import bulk_enrich


def enrichment(rows: DataFrame, titles: DataFrame, *, date_columns: list[str], category_columns: list[str], row_col: str, **columns) -> dict[str, DataFrame]:
    """Rows with their best reference match, their health, and their odd values."""
    enriched = bulk_enrich(rows, titles, row_col=row_col, **columns)
    health = profile.table_health(profile.row_health_in_table(enriched, row_col))
    return {"rows": enriched, "health": health, "anomalies": profile.detect_all(enriched, row_col, date_columns, category_columns)}


def full_qa(rows: DataFrame, checks: list[rules.Rule], *, title: str, keys: list[str], row_col: str, threshold: float = 0.85, **options) -> dict[str, DataFrame]:
    """Issues by rules, exact and fuzzy duplicates, and health of a table."""
    return {
        "issues": rules.validate(rows, checks, row_col=row_col, **options),
        "exact": duplicates.exact_duplicates(rows, keys, row_col=row_col),
        "fuzzy": duplicates.fuzzy_duplicates(rows, title, threshold, row_col=row_col),
        "health": profile.table_health(profile.row_health_in_table(rows, row_col)),
    }


def comparison(a: DataFrame, b: DataFrame, keys: list[str] | None = None, order: str | None = None) -> dict[str, DataFrame]:
    """Differences of two versions of a table, and their counts."""
    diff = compare.compare(a, b, keys, order)
    return {"diff": diff, "counts": compare.compare_counts(diff)}
