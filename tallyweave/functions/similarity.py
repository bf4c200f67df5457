"""String similarities that Spark has no built-in for, as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity raised by a tenth of what is missing for each of up to 4 common first letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        free.setdefault(c, []).append(j)
    first, second = [], []
    for i, c in enumerate(a):
        places = free.get(c, ())
        j = next((j for j in places if j >= i - reach), None)
        if j is not None and j <= i + reach:
            places.remove(j)
            first.append(c)
            second.append(j)
    same = len(first)
    if not same:
        return 0.0
    swapped = sum(c != b[j] for c, j in zip(first, sorted(second), strict=True)) // 2
    jaro = (same / len(a) + same / len(b) + (same - swapped) / same) / 3.0
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1.0 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio; the order of the arguments matters."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: Texts of one side that a task compares; more of like length and first letter are dealt out as several blocks.
BLOCK = 2_000
#: Lengths above this are banded, and first letters are hashed, so that there are some 3000 kinds of texts at most.
EXACT_LENGTHS, FIRST_LETTERS = 64, 16
KEYS = ["u", "i", "w", "j"]


class Letters:
    """The texts of a block as arrays: lengths, letters by place, and how often each letter occurs."""

    def __init__(self, texts: list[str], index: dict[str, int]):
        self.texts, self.sizes = texts, np.array([len(t) for t in texts], np.int64)
        self.counts: dict[int, dict[int, int]] = {}
        self.codes = np.full((len(texts), 64), -1, np.int32)
        for i, t in enumerate(texts):
            codes = [index[c] for c in t]
            self.codes[i, : min(len(t), 64)] = codes[:64]
            for k in codes:
                held = self.counts.setdefault(k, {})
                held[i] = held.get(i, 0) + 1


def letters_of(left: list[str], right: list[str]) -> tuple[Letters, Letters]:
    index = {c: k for k, c in enumerate(sorted({c for t in (*left, *right) for c in t}))}
    return Letters(left, index), Letters(right, index)


def common_letters(a: Letters, b: Letters) -> np.ndarray:
    """How many letters each two texts share, repeats counted (left x right): no similarity can match more."""
    most = max([0, *a.sizes.tolist(), *b.sizes.tolist()])
    total = np.zeros((len(a.texts), len(b.texts)), np.uint8 if most < 256 else np.int32)
    for k, held in a.counts.items():
        other = b.counts.get(k)
        if not other:
            continue
        x, y = np.array(list(held.values()), total.dtype), np.array(list(other.values()), total.dtype)
        shared = np.minimum.outer(x, y)
        if shared.shape == total.shape:
            total[np.ix_(list(held), list(other))] += shared
        else:
            total[np.array(list(held))[:, None], np.array(list(other))] += shared
    return total


def common_prefix(a: Letters, b: Letters) -> np.ndarray:
    """How many of the first four letters each two texts share from the start."""
    same = np.ones((len(a.texts), len(b.texts)), bool)
    found = np.zeros(same.shape, np.int8)
    for place in range(4):
        x, y = a.codes[:, place], b.codes[:, place]
        same &= (x[:, None] == y) & (x >= 0)[:, None]
        found += same
    return found


def _windows() -> np.ndarray:
    """Bits of the places that a letter may match at, by its place and the reach."""
    table = np.zeros((64, 64), np.uint64)
    for i in range(64):
        for r in range(64):
            lo, hi = max(i - r, 0), min(i + r, 63)
            table[i, r] = ((1 << (hi - lo + 1)) - 1) << lo
    return table


def jaro_winkler_of_pairs(a: Letters, b: Letters, i: np.ndarray, j: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """:func:`jaro_winkler_of` for pairs of texts of up to 64 letters, letter places as bits, all pairs at a time."""
    alphabet = 1 + max([0, *a.counts, *b.counts])
    places = np.zeros((alphabet + 1, len(b.texts)), np.uint64)  # the last row is for places beyond a text
    for place in range(64):
        held = np.flatnonzero(b.codes[:, place] >= 0)
        places[b.codes[held, place], held] |= np.uint64(1 << place)
    windows, one = _windows(), np.uint64(1)
    n, m = a.sizes[i], b.sizes[j]
    reach = np.clip(np.maximum(n, m) // 2 - 1, 0, 63)
    used, same, hits = np.zeros(len(i), np.uint64), np.zeros(len(i), np.int64), []
    for place in range(int(n.max(initial=0))):
        k = a.codes[i, place]
        free = places[k, j] & windows[place, reach] & ~used
        used |= free & (~free + one)
        hits.append(free != 0)
        same += hits[-1]
    rest, swapped = used.copy(), np.zeros(len(i), np.int64)
    for place, hit in enumerate(hits):
        low = np.where(hit, rest & (~rest + one), np.uint64(0))
        swapped += hit & ((places[a.codes[i, place], j] & low) == 0)
        rest ^= low
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(same > 0, (same / n + same / m + (same - swapped // 2) / same) / 3.0, 0.0)
    return jaro + prefix * 0.1 * (1.0 - jaro)


def near_jaro_winkler(left: list[str], right: list[str] | None, threshold: float) -> list[tuple[str, str, float]]:
    """Pairs of a block's texts with those of another (or among themselves) from ``threshold`` on.

    The text that is smaller in code-point order comes first, as the order can matter to the similarity.
    """
    order = lambda texts: sorted(texts, key=str.encode)
    a, b = letters_of(order(left), order(left if right is None else right))
    shared, prefix = common_letters(a, b).astype(np.float32), common_prefix(a, b)
    # all common letters matched, none out of order
    most = (shared / np.maximum(a.sizes, 1)[:, None].astype(np.float32) + shared / np.maximum(b.sizes, 1).astype(np.float32) + 1) / 3
    most += np.float32(0.1) * prefix * (1 - most)
    able = (most >= threshold - 1e-4) & (shared > 0)
    first = np.searchsorted(np.array([t.encode().hex() for t in b.texts], object), [t.encode().hex() for t in a.texts], side="right")
    above = np.arange(len(b.texts)) >= first[:, None]  # the other text is larger
    found = near_of(a, b, *np.nonzero(able & above), prefix, threshold)
    return found if right is None else found + near_of(b, a, *np.nonzero((able & ~above).T), prefix.T, threshold)


def near_of(a: Letters, b: Letters, i: np.ndarray, j: np.ndarray, prefix: np.ndarray, threshold: float) -> list[tuple[str, str, float]]:
    short = (a.sizes[i] <= 64) & (b.sizes[j] <= 64)
    value = np.array([0.0 if s else jaro_winkler_of(a.texts[x], b.texts[y]) for s, x, y in zip(short.tolist(), i.tolist(), j.tolist(), strict=True)])
    if short.any():
        value[short] = jaro_winkler_of_pairs(a, b, i[short], j[short], prefix[i[short], j[short]])
    near = value >= threshold
    return [(a.texts[x], b.texts[y], v) for x, y, v in zip(i[near].tolist(), j[near].tolist(), value[near].tolist(), strict=True)]


def near_ratio(left: list[str], right: list[str], cutoff: float) -> list[tuple[str, str, float]]:
    a, b = letters_of(left, right)
    most = 2.0 * common_letters(a, b) / np.maximum(np.add.outer(a.sizes, b.sizes), 1)
    found = []
    for i, j in np.argwhere(most >= cutoff).tolist():
        score = SequenceMatcher(None, left[i], right[j]).ratio()
        if score >= cutoff:
            found.append((left[i], right[j], score))
    return found


def kinds_of_text(texts: DataFrame) -> DataFrame:
    """The texts of the first column as ``v`` with their length ``n``, its band and the hash of the first letter."""
    v, n = F.col(texts.columns[0]), F.length(texts.columns[0])
    band = F.when(n <= EXACT_LENGTHS, n).otherwise(EXACT_LENGTHS + F.floor(F.log(n / EXACT_LENGTHS) / np.log(1.1))).cast("int")
    return texts.select(v.alias("v"), n.alias("n"), band.alias("band"), F.pmod(F.xxhash64(F.substring(v, 1, 1)), F.lit(FIRST_LETTERS)).cast("int").alias("first"))


@dataclass
class Unit:
    """Texts of near lengths: the range of lengths, the first letters (as bits), and in how many blocks they are dealt."""

    low: int
    high: int
    firsts: int
    blocks: int


def make_units(kinds: DataFrame) -> tuple[list[Unit], DataFrame]:
    """Kinds of texts put together until a block is full, and large kinds in several blocks; with the texts in them."""
    counted = sorted(kinds.groupBy("band", "first").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high")).collect())  # a row per kind
    units, named, size = [], [], 0
    for r in counted:
        if units and size + r.c <= BLOCK:
            size, last = size + r.c, units[-1]
            units[-1] = Unit(min(last.low, r.low), max(last.high, r.high), last.firsts | 1 << r.first, 1)
        else:
            size = r.c
            units.append(Unit(r.low, r.high, 1 << r.first, -(-r.c // BLOCK)))
        named.append((r.band, r.first, len(units) - 1, units[-1].blocks))
    table = kinds.sparkSession.createDataFrame(named, "band int, first int, unit int, blocks int")
    dealt = kinds.join(F.broadcast(table), ["band", "first"])  # a row per kind
    return units, dealt.select("v", "unit", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"))


def unit_pairs(spark: SparkSession, left: list[Unit], right: list[Unit], reach: Callable[[float, bool], bool], once: bool) -> DataFrame:
    """The pairs of units whose texts can be similar: ``reach`` judges the best ratio of lengths and whether first letters can agree."""
    pairs = []
    for u, a in enumerate(left):
        for w, b in enumerate(right):
            if once and w < u:
                continue
            ratio = 1.0 if a.low <= b.high and b.low <= a.high else min(a.high, b.high) / max(a.low, b.low, 1)
            if reach(ratio, bool(a.firsts & b.firsts)):
                pairs.append((u, w, a.blocks, b.blocks))
    return spark.createDataFrame(pairs, "u int, w int, ub int, wb int")


def meet(left: DataFrame, right: DataFrame, pairs: DataFrame, once: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides once for each pair of blocks (u, i, w, j) that they are in; a block doesn't meet itself or a pair of blocks twice."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = left.withColumnRenamed("unit", "u").join(pairs, "u").select("u", F.col("block").alias("i"), "w", every("wb").alias("j"), "v")
    two = right.withColumnRenamed("unit", "w").join(pairs, "w").select("u", every("ub").alias("i"), "w", F.col("block").alias("j"), "v")
    if once:
        one, two = one.filter("u < w OR i <= j"), two.filter("u < w OR i < j")
    return one, two.select(*[F.col(c).alias(f"{c}2") for c in two.columns])


def jaro_winkler_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a < b) of the distinct texts in the first column whose Jaro-Winkler similarity reaches ``threshold``.

    Every two texts that can reach it are compared: with no letter matched out of
    order, m common letters of lengths p and q give (m/p + m/q + 1) / 3, and the
    prefix adds a tenth of what is missing for each of four letters.  So texts meet, in blocks,
    only where the ratio of their lengths allows the threshold - a wider range where
    first letters agree -, and in a task the letters in common are counted for whole
    blocks before places are looked at.  The work left is quadratic in the texts of like length.
    """
    spark = texts.sparkSession
    units, dealt = make_units(kinds_of_text(texts))
    if len(units) == 1 and units[0].blocks == 1:

        def among(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(near_jaro_winkler(group["v"].tolist(), None, threshold), columns=["a", "b", "similarity"])

        return dealt.groupBy("unit").applyInPandas(among, "a string, b string, similarity double")
    # without a common first letter there is no prefix; with all four, Jaro need only reach (t - 0.4) / 0.6
    least = {False: 3 * threshold - 2, True: 3 * (threshold - 0.4) / 0.6 - 2}
    one, two = meet(dealt, dealt, unit_pairs(spark, units, units, lambda ratio, first: ratio >= least[first] - 1e-9, True), True)

    def compare(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        itself = key[0] == key[2] and key[1] == key[3]
        found = near_jaro_winkler(x["v"].tolist(), None if itself else y["v2"].tolist(), threshold) if len(x) and (itself or len(y)) else []
        return pd.DataFrame(found, columns=["a", "b", "similarity"])

    return one.groupBy(KEYS).cogroup(two.groupBy([f"{k}2" for k in KEYS])).applyInPandas(compare, "a string, b string, similarity double")


def ratio_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """All pairs (target, entry) of texts of the two first columns whose difflib ratio reaches ``cutoff``.

    Blocks meet only where the lengths allow it (2 * shorter / sum), and pairs with too few
    common letters for the cutoff are left out before difflib compares.
    """
    spark = left.sparkSession
    (some, targets), (others, entries) = make_units(kinds_of_text(left)), make_units(kinds_of_text(right))
    one, two = meet(targets, entries, unit_pairs(spark, some, others, lambda ratio, _: 2 * ratio / (1 + ratio) >= cutoff - 1e-9, False), False)

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = near_ratio(x["v"].tolist(), y["v2"].tolist(), cutoff) if len(x) and len(y) else []
        return pd.DataFrame(found, columns=["target", "entry", "score"])

    return one.groupBy(KEYS).cogroup(two.groupBy([f"{k}2" for k in KEYS])).applyInPandas(compare, "target string, entry string, score double")
