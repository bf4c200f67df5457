"""Differences between table versions, record pairs and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Columns that hold one entry per line, in any order.
MULTILINE_COLUMNS = ["brand_set", "composite_brand_set", "twitter_search_terms", "instagram_business_hashtags", "twitter_search_term_keywords", "url_managers", "title_sub_category", "companies", "genre"]
# The column that maintains the URL of each platform of a URL manager.
PLATFORM_COLUMNS = {
    "facebook": "facebook_page", "twitter": "twitter_handle", "instagram": "instagram_user", "youtube": "youtube_channel_username",
    "tiktok": "tiktok_user", "linkedin": "linkedin_page", "threads": "threads_page", "pinterest": "pinterest_user_username",
}


def row_key(keys: list[str]) -> Column:
    return F.concat_ws("||", *[T.norm_value(F.col(f"`{k}`")) for k in keys])


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return df.withColumn("__turn", turn).filter("__turn = 1").drop("__turn")


def compare(a: DataFrame, b: DataFrame, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Differences of two versions by key: row_key, status, column, value_a, value_b.

    Added and removed rows have one row with null column; modified rows one per
    differing common column; unchanged rows one with null column.  Of rows with
    one key the last in ``order`` counts (any, without an order).  Without keys
    the second column is the key, or the first of a table of one.
    """
    keys = keys or [a.columns[1] if len(a.columns) > 1 else a.columns[0]]
    missing = [k for k in keys if k not in a.columns or k not in b.columns]
    if missing:
        raise ValueError(f"key columns not in both tables: {missing}")
    common = [c for c in a.columns if c in b.columns]
    sides = []
    for side, df in (("a", a), ("b", b)):
        kept = df.withColumn("row_key", row_key(keys)).filter(F.regexp_replace("row_key", r"\|", "") != "" if len(keys) == 1 else F.lit(True))
        kept = keep_last(kept, "row_key", order) if order else kept.dropDuplicates(["row_key"])
        sides.append(kept.select("row_key", F.struct(*[T.text(F.col(f"`{c}`")).alias(c) for c in common]).alias(side)))
    joined = sides[0].join(sides[1], "row_key", "full_outer")
    changed = F.filter(F.array(*[F.when(F.col("a")[c] != F.col("b")[c], F.struct(F.lit(c).alias("column"), F.col("a")[c].alias("value_a"), F.col("b")[c].alias("value_b"))) for c in common]), lambda x: x.isNotNull())
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(changed) > 0, "modified").otherwise("unchanged")
    each = joined.select("row_key", status.alias("status"), changed.alias("changed"))
    return each.select("row_key", "status", F.inline_outer(F.when(F.col("status") == "modified", F.col("changed"))))


def compare_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count_distinct("row_key").alias("rows"))


def pair_diff(df: DataFrame, id_col: str = "brand_id", type_col: str = "record_type", skip: tuple[str, ...] = ()) -> DataFrame:
    """INGESTED against FROM DB per id: id, column, kind (added, removed, changed, or missing), values.

    Columns of ``MULTILINE_COLUMNS`` compare as sets of lines.  Of several rows
    of one type the last by value order counts.  An id with one of the two
    rows only gives a row of kind "missing INGESTED" or "missing FROM DB".
    """
    columns = [c for c in df.columns if c.casefold() != type_col.casefold() and c != id_col and c not in skip]
    kind = F.upper(T.text(F.col(type_col)))
    rows = df.filter(F.col(id_col).isNotNull() & kind.isin("INGESTED", "FROM DB"))
    cells = F.struct(*[T.text(F.col(f"`{c}`")).alias(c) for c in columns])
    pairs = rows.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.max(F.when(kind == "INGESTED", cells)).alias("i"), F.max(F.when(kind == "FROM DB", cells)).alias("d"))
    parts = []
    for c in columns:
        new, old = F.col("i")[c], F.col("d")[c]
        same = T.line_set(new) == T.line_set(old) if c.casefold() in MULTILINE_COLUMNS else new == old
        how = F.when((new != "") & (old == ""), "added").when((old != "") & (new == ""), "removed").otherwise("changed")
        parts.append(F.when(F.col("i").isNotNull() & F.col("d").isNotNull() & ~same, F.struct(F.lit(c).alias("column"), how.alias("kind"), new.alias("ingested"), T.shorten(old).alias("database"))))
    gap = F.when(F.col("i").isNull(), "missing INGESTED").when(F.col("d").isNull(), "missing FROM DB")
    none = F.lit(None).cast("string")
    parts.append(F.when(gap.isNotNull(), F.struct(none.alias("column"), gap.alias("kind"), none.alias("ingested"), none.alias("database"))))
    return pairs.select("id", F.inline(F.filter(F.array(*parts), lambda x: x.isNotNull())))


def slug_key(c: Column) -> Column:
    """Last part of a URL or handle, without @, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(T.text(c), r"/+\z", ""), r"^(?i)https?://(?:www\.)?", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"^.*/", ""), "^@+", ""))


def url_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(T.text(c), r"/+\z", ""), r"^(?i)https?://(?:www\.)?", ""))


def url_manager_check(df: DataFrame, id_cols: list[str], manager_col: str = "url_managers", platform_columns: dict[str, str] | None = None) -> DataFrame:
    """Per row and platform: the manager's entry against the maintained value.

    Statuses: OK, MISMATCH, MISSING (no entry) and ORPHAN (nothing maintained).
    Of several entries for a platform the last counts; any line of the maintained
    cell may match by slug or by URL.  One projection, no shuffle.
    """
    columns = {p: c for p, c in (platform_columns or PLATFORM_COLUMNS).items() if c in df.columns}
    parts = F.transform(F.split(F.coalesce(F.col(manager_col), F.lit("")), "\n"), lambda x: F.transform(F.split(x, r"\|"), lambda y: F.regexp_replace(y, T.EDGES, "")))
    entries = F.filter(parts, lambda p: (F.size(p) >= 2) & (p[0] != ""))
    made = []

    def matches(entry):
        return lambda x: (slug_key(entry) == slug_key(x)) | (url_key(entry) == url_key(x))

    def named(platform):
        return lambda p: F.lower(p[0]) == platform

    for platform in platform_columns or PLATFORM_COLUMNS:
        mine = F.filter(F.col("__entries"), named(platform))
        entry = F.try_element_at(F.try_element_at(mine, F.lit(-1)), F.lit(2))
        kept = T.text(F.col(f"`{columns[platform]}`")) if platform in columns else F.lit("")
        lines = F.filter(F.split(kept, "\n"), lambda x: T.text(x) != "")
        match = F.exists(lines, matches(entry))
        status = F.when(entry.isNull() & (kept != ""), "MISSING").when(entry.isNotNull() & (kept == ""), "ORPHAN").when(entry.isNotNull() & match, "OK").when(entry.isNotNull(), "MISMATCH")
        made.append(F.when(status.isNotNull(), F.struct(F.lit(platform).alias("platform"), F.coalesce(entry, F.lit("")).alias("entry"), kept.alias("maintained"), status.alias("status"))))
    found = F.filter(F.array(*made), lambda x: x.isNotNull())
    return df.withColumn("__entries", entries).select(*id_cols, F.inline(found))


def snapshot_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to write (``upsert``: new or changed) and keys to delete (``removed``) between two snapshots."""
    values = [c for c in new.columns if c not in keys]
    struct = lambda: F.struct(*values) if values else F.struct(F.lit(1).alias("_"))
    a = old.select(*keys, struct().alias("__old"), F.lit(True).alias("__had"))
    b = new.select(*[F.col(k).alias(f"__{k}") for k in keys], struct().alias("__new"), F.lit(True).alias("__has"))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = a.join(b, on, "full_outer").select(*[F.coalesce(f"__{k}", k).alias(k) for k in keys], "__old", "__new", "__had", "__has")
    change = F.when(F.col("__has").isNull(), "removed").when(F.col("__had").isNull() | ~F.col("__old").eqNullSafe(F.col("__new")), "upsert")
    return joined.withColumn("change", change).filter("change IS NOT NULL").select("change", *keys, *[F.col(f"__new.{v}").alias(v) for v in values])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in the place of those with equal keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)
