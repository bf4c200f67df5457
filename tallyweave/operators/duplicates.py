"""Exact and fuzzy duplicates, and identifiers shared by different entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import jaro_winkler_pairs

# The columns whose values belong to one entity.
HANDLE_COLUMNS = ["facebook_page", "twitter_handle", "instagram_user", "youtube_channel_username", "tiktok_user", "wikidata_id", "imdb_id"]


def exact_duplicates(df: DataFrame, columns: list[str], row_col: str = "row_id") -> DataFrame:
    """Rows whose trimmed, case-folded values of ``columns`` occur more than once.

    Adds ``group_row`` (smallest row id of the group, which names and orders it)
    and ``group_size``.  Rows that are blank in all columns are in no group.
    Groups are counted map-side; only keys with more than one row join back.
    """
    values = [T.norm_value(F.col(c)) for c in columns]
    some = reduce(lambda a, b: a | b, [v != "" for v in values])
    keyed = df.filter(some).withColumn("__key", F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)]))
    groups = keyed.groupBy("__key").agg(F.min(row_col).alias("group_row"), F.count("*").alias("group_size")).filter("group_size > 1")
    return keyed.join(groups, "__key").drop("__key")


def duplicates_by_id(df: DataFrame, id_col: str, row_col: str = "row_id") -> DataFrame:
    return exact_duplicates(df, [id_col], row_col)


def duplicate_totals(groups: DataFrame) -> DataFrame:
    """Groups and affected rows of a duplicate report."""
    return groups.agg(F.count_distinct("group_row").alias("groups"), F.count("*").alias("affected_rows"))


def duplicate_conflicts(df: DataFrame, title_col: str = "title", handle_columns: list[str] | None = None, row_col: str = "row_num") -> DataFrame:
    """Titles on several rows, and handles or ids that rows of different titles share.

    Returns (row_num, column, kind, value, others): the other rows of the group,
    as many as it has members.
    """
    handles = [c for c in (handle_columns or HANDLE_COLUMNS) if c in df.columns]
    title = T.norm_value(F.col(title_col))
    kept = df.select(F.col(row_col).alias("row_num"), F.col(title_col).cast("string").alias("title"), title.alias("t"), *[F.col(c).cast("string").alias(f"h_{c}") for c in handles])
    named = kept.filter("t <> ''").select("row_num", F.lit(title_col).alias("column"), F.lit("Duplicate entity").alias("kind"), F.col("title").alias("value"), F.col("t").alias("key"), F.lit(None).cast("string").alias("t"))
    shared = kept.select("row_num", F.when(F.col("t") == "", F.concat(F.lit("row "), "row_num")).otherwise(F.col("t")).alias("t"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"h_{c}").alias("value")) for c in handles]))) if handles else None
    parts = named
    if shared is not None:
        shared = shared.withColumn("key", T.norm_value(F.col("value"))).filter("key <> ''")
        parts = named.unionByName(shared.select("row_num", "column", F.lit("Conflicting handle").alias("kind"), "value", "key", "t"))
    groups = parts.groupBy("column", "kind", "key").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    groups = groups.filter(F.when(F.col("kind") == "Duplicate entity", F.col("n") > 1).otherwise(F.col("lo") != F.col("hi")))
    return parts.join(groups, ["column", "kind", "key"]).select("row_num", "column", "kind", "value", (F.col("n") - 1).alias("others"))


def conflict_messages(df: DataFrame, conflicts: DataFrame, most: int | None = 20) -> DataFrame:
    """A message per conflict that lists the other rows: the first ``most``, or all of them with None.

    All messages of a group of n rows together name n * n rows, so long groups are cut unless asked for.
    """
    key = F.lower(F.trim("value"))
    rows = conflicts.withColumn("key", key)
    rank = F.row_number().over(Window.partitionBy("column", "kind", "key").orderBy("row_num"))
    some = rows if most is None else rows.withColumn("r", rank).filter(F.col("r") <= most + 1)
    listed = some.groupBy("column", "kind", "key").agg(F.array_sort(F.collect_list("row_num")).alias("rows"))
    joined = rows.join(listed, ["column", "kind", "key"])
    rest = F.array_except("rows", F.array("row_num"))
    others = F.array_join(F.transform(rest if most is None else F.slice(rest, 1, most), lambda x: x.cast("string")), ", ")
    return joined.select("row_num", "column", F.concat(F.col("kind"), F.lit(": '"), "value", F.lit("' also on row(s): "), others).alias("message"))


def fuzzy_pairs(values: DataFrame, value_col: str, threshold: float = 0.85) -> DataFrame:
    """All pairs (a < b) of distinct texts with Jaro-Winkler similarity from ``threshold`` on.

    Every two texts are compared, in blocks, so none is missed; nulls and empty texts have no pair.
    """
    v = values.select(F.col(value_col).alias("v")).filter("v IS NOT NULL AND v <> ''").distinct()
    return jaro_winkler_pairs(v, threshold)


def fuzzy_duplicates(df: DataFrame, column: str, threshold: float = 0.85, row_col: str = "row_id") -> DataFrame:
    """Greedy leader clusters: the first row leads, later similar rows that are free join it.

    The same clusters as a pass in row order: a text leads once no earlier
    similar text leads or is undecided, and joins its earliest leader.  Rounds
    decide all texts whose earlier neighbours are decided, until none is left (a chain
    of texts takes a round per link); each is checkpointed.
    Returns the rows in groups of two and more with ``group_row`` and ``similarity``
    (the best of the group with its leader, 4 decimals).
    """
    rows = df.select(F.col(row_col).alias("row_id"), T.norm_lookup(F.col(column)).alias("v")).filter("v <> ''")
    nodes = rows.groupBy("v").agg(F.min("row_id").alias("first"), F.count("*").alias("n"))
    nodes = nodes.checkpoint()
    pairs = fuzzy_pairs(nodes, "v", threshold)
    first = nodes.select("v", "first")
    edges = pairs.join(first.toDF("a", "fa"), "a").join(first.toDF("b", "fb"), "b")
    # from the later text to the earlier one
    edges = edges.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("v"), F.when(F.col("fa") < F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("u"), "similarity").checkpoint()
    state = first.withColumn("leader", F.lit(None).cast("string")).checkpoint()
    undecided = None
    while undecided != 0:
        seen = edges.join(state.select(F.col("v").alias("u"), F.col("first").alias("uf"), F.col("leader").alias("ul")), "u")
        facts = seen.groupBy("v").agg(
            F.min(F.when(F.col("ul") == F.col("u"), F.struct("uf", "u"))).alias("best"),
            F.min(F.when(F.col("ul").isNull(), F.col("uf"))).alias("open"),
        )
        joined = state.join(facts, "v", "left")
        free = F.col("open").isNull()
        sure = F.col("best").isNotNull() & (free | (F.col("best.uf") < F.col("open")))
        lead = F.coalesce("leader", F.when(sure, F.col("best.u")).when(free & F.col("best").isNull(), F.col("v")))
        state = joined.select("v", "first", lead.alias("leader")).checkpoint()
        before, undecided = undecided, state.filter("leader IS NULL").count()
        if undecided and undecided == before:
            raise RuntimeError(f"{undecided} texts stay undecided")
    score = edges.withColumnRenamed("u", "leader")
    named = state.join(score, ["v", "leader"], "left").join(first.toDF("leader", "group_row"), "leader")
    grouped = rows.join(named.select("v", "group_row", F.coalesce("similarity", F.lit(1.0)).alias("similarity"), (F.col("first") == F.col("group_row")).alias("own")), "v")
    # a leader's own row has no similarity; its copies have 1
    best = grouped.groupBy("group_row").agg(F.count("*").alias("n"), F.max(F.when(F.col("row_id") != F.col("group_row"), F.col("similarity"))).alias("similarity")).filter("n > 1")
    return grouped.select("row_id", "group_row").join(best.select("group_row", F.round("similarity", 4).alias("similarity")), "group_row")


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """Of the rows with equal keys the first in ``order`` (a total order gives the same row each time)."""
    named = df.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    turn = F.row_number().over(Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy(*order))
    return named.withColumn("__turn", turn).filter("__turn = 1").select(*df.columns)
