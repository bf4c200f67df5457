"""Mixing sources to target weights, with built-in functions only.

The method: every document has a hash.  Sizes are summed by source and by the
leading bits of the hash; the running sums of such a histogram show in which
bucket a source's budget ends, and only that bucket is refined by the next bits,
until it holds one hash value.  The nested thresholds then filter the documents
without sorting any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, unused

#: Sources whose rows are broadcast; more are met by a shuffle, each in ``SALTS`` parts.
MOST_SOURCES = 100_000
SALTS = 64
#: Hash bits of one histogram level and the number of levels; together 60 bits.
LEVEL_BITS = 12
LEVELS = 5


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(key: Column, text: Column) -> Column:
    """60 bits of the MD5 of an id and a text; null counts as empty text.  Only rows that agree in both share one."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    digits = F.substring(F.md5(F.concat(part(key), F.lit("\x1f"), part(text)).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """One row per source: its size and its target.

    ``sizes`` has (source, source_size).  Sources in code-point order, null last,
    get the weights in turn.  The targets share the total of all sizes by weight;
    none exceeds ``cap`` times its source's size, and what is above is shared
    again among the rest.  In order of cap per weight the capped sources come
    first, so running sums give the level at which the rest shares what is left.
    There is one row per source, so the unpartitioned windows stay small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    table = (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    )
    # the first source in that order whose share stays under its cap sets the level of all that follow
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"]
    share = F.col("weight") * level
    target = F.when(level.isNull() | (share > F.col("most")), F.col("most")).otherwise(share)
    return table.select("source", "source_size", target.alias("target"))


def join_sources(rows: DataFrame, source: Column, h: Column, table: DataFrame, name: str, few: bool, how: str = "inner") -> DataFrame:
    """Rows with the row of their source in ``table`` (source in the column ``name``).

    A table of few sources is broadcast; of many, every source is in ``SALTS``
    parts, by hash, so that a source with most of the rows doesn't gather in a task.
    """
    if few:
        return rows.join(F.broadcast(table), source.eqNullSafe(F.col(name)), how)
    a, b = unused(rows, "salt_a"), unused(rows, "salt_b")
    parts = table.withColumn(b, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.withColumn(a, F.pmod(h, F.lit(SALTS)).cast("int")).join(parts, source.eqNullSafe(F.col(name)) & (F.col(a) == F.col(b)), how)
    return met.drop(a, b)


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many copies of each document the mix takes.

    Returns every column of ``docs`` and, in the struct ``mix``: size (words),
    source_size, target, copies (0 up to ``cap``) and taken (= size * copies).
    A source whose target is n sizes and a rest gives every document n times,
    and once more those below a hash threshold whose sizes sum to the rest, to
    within half of the document at the threshold.  Where rows of one id and text
    stand at the threshold, as many of them are taken as fit.

    The decision depends on id, source and text only, so reruns agree but for which
    of such equal rows are taken.  Ids may repeat or be null: rows differ by their texts.
    Null sources are a source of their own; null or empty text has size 0 and is
    taken 0 times over (its copies follow the threshold all the same); an empty table gives
    an empty result.  Extra columns pass through, a column named ``mix`` is
    replaced.
    """
    slim = cut(
        docs.select(F.col(source_col).cast("string").alias("source"), order_hash(F.col(id_col), F.col(text_col)).alias("h"), word_count(F.col(text_col)).alias("size")),
        "mix-sizes",
    )
    totals = cut(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    few = totals.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    limits = cut(mix_thresholds(slim, totals, weights, cap, few), "mix-thresholds")
    return apply_mix(docs, limits, few, id_col=id_col, text_col=text_col, source_col=source_col)


def mix_thresholds(slim: DataFrame, totals: DataFrame, weights: tuple[float, ...], cap: float, few: bool) -> DataFrame:
    """One row per source: size, target, base copies, the hash below which one more is taken, and of how many rows at the hash ``edge`` (``edge_rows``)."""
    targets = source_targets(totals, weights, cap).select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("base"),
    ).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    bound = targets.select("s", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"))
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        at = join_sources(slim.filter("size > 0"), F.col("source"), F.col("h"), bound.drop("inside", "n"), "s", few).filter(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        hist = at.groupBy("s", "budget", "below", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("inside"), F.count("*").alias("n"))
        run = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        below = F.col("below") + F.coalesce(F.sum("inside").over(run), F.lit(0))
        bound = (
            hist.withColumn("below", below.cast("double"))
            .filter((F.col("below") <= F.col("budget")) & (F.col("below") + F.col("inside") > F.col("budget")))
            .select("s", "budget", F.col("bucket").alias("prefix"), "below", "inside", "n")
        )
    # a threshold is exclusive; of the rows at the boundary those are taken of which at least half fits
    some = bound.withColumn("some", F.floor((F.col("budget") - F.col("below")) * F.col("n") / F.col("inside") + 0.5))
    partly = (F.col("some") > 0) & (F.col("some") < F.col("n"))
    last = some.select(F.col("s").alias("b"), (F.col("prefix") + (F.col("some") >= F.col("n")).cast("long")).alias("threshold"), F.when(partly, F.col("prefix")).alias("edge"), F.when(partly, F.col("some")).alias("edge_rows"))
    joined = targets.join(F.broadcast(last) if few else last, F.col("s").eqNullSafe(F.col("b")), "left")
    return joined.select("s", "source_size", "target", "base", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold"), "edge", "edge_rows")


def apply_mix(docs: DataFrame, limits: DataFrame, few: bool, *, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Filter by the thresholds: with few sources their rows are broadcast, and no document moves."""
    names = [c for c in docs.columns if c != "mix"]
    new = {c: unused(docs, f"mix_{c}") for c in limits.columns}
    limits = limits.select(*[F.col(c).alias(n) for c, n in new.items()])
    h, size = order_hash(F.col(id_col), F.col(text_col)), word_count(F.col(text_col))
    joined = join_sources(docs, F.col(source_col).cast("string"), h, limits, new["s"], few, "left")
    more = h < F.col(new["threshold"])
    if limits.filter(F.col(new["edge"]).isNotNull()).limit(1).count():
        # equal rows at the threshold are numbered, part by part, and the first ones taken
        part, at, pos = (unused(joined, f"mix_{c}") for c in ("part", "at", "pos"))
        edge = F.coalesce((h == F.col(new["edge"])) & (size > 0), F.lit(False))
        equal = cut(joined.filter(edge).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "mix-edge")
        parts = equal.groupBy(F.col(new["s"]).alias("s"), F.col(part).alias("p")).agg(F.min(at).alias("first"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.select(F.col("s").alias(part + "_s"), F.col("p").alias(part + "_p"), (before - F.col("first")).alias(part + "_n"))
        equal = equal.join(parts, F.col(new["s"]).eqNullSafe(F.col(part + "_s")) & (F.col(part) == F.col(part + "_p"))).withColumn(pos, F.col(at) + F.col(part + "_n"))
        joined = joined.filter(~edge).withColumn(pos, F.lit(None).cast("long")).unionByName(equal.select(*joined.columns, pos))
        more = F.coalesce(F.col(pos) < F.col(new["edge_rows"]), more)
    copies = F.col(new["base"]) + F.when(more, 1).otherwise(0)
    mix = F.struct(size.alias("size"), F.col(new["source_size"]).alias("source_size"), F.col(new["target"]).alias("target"), copies.cast("int").alias("copies"), (size * copies).alias("taken"))
    return joined.withColumn("mix", mix).select(*names, "mix")


#: The same mix as DuckDB SQL over a relation ``docs`` (doc_id, text, source), with every row in order: it is taken once more if half of it fits.
MIX_SQL = r"""
sized AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM docs),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight,
    3.0::DOUBLE * source_size AS most, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM per),
levelled AS (SELECT *, most / weight AS ratio,
    (total - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
shared AS (SELECT source, source_size, most, weight * (SELECT level FROM levelled WHERE ratio >= level ORDER BY ratio, level LIMIT 1) AS share FROM levelled),
targets AS (SELECT source, source_size, CASE WHEN share IS NULL OR share > most THEN most ELSE share END AS target FROM shared),
based AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM targets),
ordered AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::DOUBLE AS middle FROM sized),
mixed AS (SELECT o.*, b.source_size, b.target, b.base + CASE WHEN o.middle <= b.target - b.base * b.source_size THEN 1 ELSE 0 END AS copies
    FROM ordered o JOIN based b ON o.source IS NOT DISTINCT FROM b.source)
"""
