"""Near-duplicate embeddings: random-hyperplane tables, exact cosines, components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

#: Vectors of one bucket compared in one task; a larger bucket is compared block by block.
BLOCK = 512
#: Sign bits of a vector's sketch, in 64-bit words.
SKETCH = 4


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Tables of ``bits`` sign bits that find a pair at the threshold with probability ``recall``."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - same))


def bits_for(rows: int) -> int:
    """Sign bits that leave some tens of unrelated vectors in a bucket."""
    return min(24, max(8, round(math.log2(max(rows, 1) / 32))))


def signatures(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """Sign bits of each vector in each table (rows x tables); planes depend on seed and width only."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).normal(size=(vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def cosines(x: np.ndarray, y: np.ndarray, scale: bool = False) -> np.ndarray:
    """Cosines of rows; with ``scale``, of vectors whose squares may not fit a double."""
    if scale:
        x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x @ y.T) / np.outer(np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1)))


def spanning_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the rows of a symmetric boolean matrix as all its links do."""
    rest, edges = np.arange(len(linked)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = linked[x, rest]
            if near.any():
                edges += [(x, y) for y in rest[near]]
                queue += list(rest[near])
                rest = rest[~near]
    return edges


def sketch_limit(threshold: float) -> int:
    """Differing sketch bits of which a pair at the threshold has more once in some 10^9 times (six standard deviations)."""
    bits, p = 64 * SKETCH, math.acos(threshold) / math.pi
    return math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def part_of(column):
    """A function of i and j: rows i to j of an Arrow column, lists of one bucket as a matrix."""
    if pa.types.is_list(column.type):
        values, at = np.asarray(column.flatten()), np.asarray(column.offsets) - column.offsets[0].as_py()
        return lambda i, j: values[at[i] : at[j]].reshape(j - i, -1)
    values = np.array(column.to_pylist(), dtype=object) if pa.types.is_string(column.type) else np.asarray(column)
    return lambda i, j: values[i:j]


def groups_of(batches, columns: int):
    """Members of one bucket (equal first two columns) at a time, from rows in bucket order: lists of ``columns`` arrays."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        g1, g2 = (np.asarray(batch.column(i)) for i in range(2))
        starts = np.flatnonzero(np.concatenate(([True], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]))))
        parts = [part_of(batch.column(i)) for i in range(2, 2 + columns)]
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(g1)], strict=True):
            if (g1[i], g2[i]) != name:
                if held:
                    yield name, [np.concatenate(x) for x in zip(*held, strict=True)]
                held, name = [], (g1[i], g2[i])
            held.append([part(i, j) for part in parts])
    if held:
        yield name, [np.concatenate(x) for x in zip(*held, strict=True)]


def bucket_survivors(threshold: float):
    """Tasks over (bucket, table, blocks differ, block, class, sketch): the members with another whose sketch is near."""
    limit = sketch_limit(threshold)

    def run(batches):
        for (g1, g2), (t, apart, b, c, sketch) in groups_of(batches, 5):
            # signs as 1 and -1: a product counts equal bits less different ones
            signs = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
            close = signs @ signs.T >= 64 * SKETCH - 2 * limit
            if apart[0]:
                close &= b[:, None] != b[None, :]
            np.fill_diagonal(close, False)
            near = close.any(axis=1)
            at = np.flatnonzero(near)
            if len(at):
                n = len(at)
                arrays = [pa.array(x) for x in (np.full(n, g1), np.full(n, g2), t[at], apart[at], b[at])]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(c[at].tolist(), pa.string())], ["g1", "g2", "t", "apart", "b", "c"])

    return run


def bucket_links(threshold: float, tables: int, bits: int, seed: int):
    """Tasks over (bucket, table, blocks differ, block, class, count, vector): links of each class, and edges that join them.

    A task holds one bucket (or pair of blocks) at a time.  Only vectors that
    link get their signatures again, to leave pairs to the first table where they meet.
    """

    def links_of(t, apart, b, c, n, x, out):
        linked = cosines(x, x, scale=True) >= threshold
        np.fill_diagonal(linked, False)
        if apart[0]:
            linked &= b[:, None] != b[None, :]
        some = np.flatnonzero(linked.any(axis=1))
        if not len(some):
            return
        linked, s = linked[np.ix_(some, some)], signatures(x[some], tables, bits, seed)
        for earlier in range(t[0]):
            linked &= s[:, earlier, None] != s[None, :, earlier]
        links = linked.astype(np.float64) @ n[some]
        out += [(c[i], None, int(k)) for i, k in zip(some, links, strict=True) if k]
        out += [(c[some[i]], c[some[j]], 0) for i, j in spanning_forest(linked)]

    def run(batches):
        out = []
        for _, (t, apart, b, c, n, x) in groups_of(batches, 6):
            if len(c) > 1:
                links_of(t, apart, b, c, n, x, out)
            if len(out) >= 20_000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["a", "b", "links"])

    return run


def usable(vector: Column) -> Column:
    """Not null, every component finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.9999, bits: int | None = None, seed: int = 11) -> DataFrame:
    """Per row: id, ``n_links`` (other rows linked directly) and ``component_id``.

    Rows link when their labels are equal and not null and the cosine of their
    vectors, in double precision, is at least ``threshold``.  Every pair that
    meets in one of the tables is verified, so no link is below it; ``tables_for``
    gives as many tables as find a pair at the threshold with ``recall``, and
    closer pairs more surely.  In a bucket, sketches of 256 sign bits are compared
    first; they leave out a pair at the threshold once in some 10^9 times.

    Equal vectors of a label are one class with a count before anything is
    compared.  A pair is counted in the first table where it meets.  A bucket
    returns sums and a spanning forest, never its pairs; buckets over ``BLOCK``
    are dealt out as pairs of blocks.

    Vectors that are null, zero, or hold null or non-finite components, and rows
    with a null label, link with nothing: 0 links, their own component.  Vectors
    of unequal length don't link.  Repeated rows are other vectors and link with
    each other; rows of equal id share that id's name for a component.  An empty
    table gives an empty result; other columns are not read.
    """
    wide = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = F.col("label").isNotNull() & usable(F.col("v"))
    # 128 bits name a class of equal vectors; unequal ones with a common name would need some 10^19 of them
    name = F.concat(F.hex(F.xxhash64("label", "v")), F.lit("-"), F.hex(F.xxhash64(F.lit(seed), "v", "label")))
    keyed = wide.withColumn("c", F.when(fit, name))
    classes = cut(keyed.filter("c IS NOT NULL").groupBy("c").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("v").alias("v")), "vectors")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits = bits or bits_for(largest)
    tables = tables_for(threshold, bits, recall)

    @F.pandas_udf("s array<long>, sketch array<long>")
    def signs(vectors: pd.Series) -> pd.DataFrame:
        out, sketch, widths = [None] * len(vectors), [None] * len(vectors), vectors.map(len)
        for width in widths.unique():
            at = np.flatnonzero(widths == width)
            stacked = np.stack(vectors.iloc[at].to_list())
            stacked = stacked / np.abs(stacked).max(axis=1, keepdims=True)
            planes = np.random.default_rng([seed + 1, width]).normal(size=(width, 64 * SKETCH))
            near = np.packbits(stacked @ planes > 0, axis=1).view(np.int64)
            for i, s, k in zip(at, signatures(stacked, tables, bits, seed), near, strict=True):
                out[i], sketch[i] = s, k
        return pd.DataFrame({"s": out, "sketch": sketch})

    # ids, signatures and sketches meet; vectors follow only where a sketch has another near it
    signed = cut(classes.select("c", "label", F.size("v").alias("width"), signs("v").alias("x")).select("c", "label", "width", "x.s", "x.sketch"), "signed")
    key = ["label", "width", "t", "sig"]
    placed = signed.select("c", "label", "width", "sketch", F.posexplode("s").alias("t", "sig"))
    sizes = placed.groupBy(*key).agg(F.count("*").alias("m")).filter("m > 1")
    met = placed.join(sizes, key)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("c"), blocks).cast("int")
    met = met.withColumn("b", mine).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("b", "o"), F.greatest("b", "o")
    bucket = [F.xxhash64(*key, low, high).alias("g1"), F.xxhash64(F.lit(seed), *key, low, high).alias("g2")]
    met = met.select(*bucket, "t", (low != high).alias("apart"), "b", "c", "sketch").repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    near = cut(met.mapInArrow(bucket_survivors(threshold), "g1 long, g2 long, t int, apart boolean, b int, c string"), "near-vectors")
    dealt = near.join(classes.select("c", "n", "v"), "c").select("g1", "g2", "t", "apart", "b", "c", "n", "v").repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    found = cut(dealt.mapInArrow(bucket_links(threshold, tables, bits, seed), "a string, b string, links long"), "vector-links")
    parts = connected_components(found.filter("b IS NOT NULL").select("a", "b"))
    counted = found.groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    joined = classes.select("c", "n", "first").join(parts.withColumnRenamed("node", "c"), "c", "left").join(counted, "c", "left")
    joined = joined.withColumn("component", F.coalesce("component", "c"))
    named = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    verdict = joined.join(named, "component").select("c", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = keyed.select("vec_id", "c").join(verdict, "c", "left")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
