"""SimHash fingerprints and near-duplicate classes by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, cut, release_memory, token_blocks, unused
from .components import connected_components

#: Rows of one table bucket that a task compares; larger buckets are split by a second index.
BUCKET_ROWS = 20_000


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash of UTF-8 text: majority of each bit over the word shingles' XXH64."""
    import xxhash

    digest = xxhash.xxh64_digest
    counts, total, last = np.zeros(64, np.int64), 0, []
    for tokens in token_blocks((text or b"").translate(LOWER_BYTES)):
        tokens = last + tokens
        shingles = zip(*(tokens[i:] for i in range(words)), strict=False)
        hashes = [digest(b" ".join(x), 42) for x in shingles]
        total += len(hashes)
        if hashes:
            bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int64)
        last = tokens[1 - words :] if words > 1 else []
    if not total and last:  # fewer words than a shingle has: the whole sequence
        return int.from_bytes(digest(b" ".join(last), 42), "big")
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big") if total else 0


def with_fingerprint(docs: DataFrame, *, text_col: str = "text", words: int = 3, name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint (64 bits as a long) as column ``name``; null or wordless text has 0."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts))
        release_memory()
        return pd.Series(found.view(np.int64))

    # declared so that no filter or join on the result makes Spark run it twice
    return docs.withColumn(name, of.asNondeterministic()(F.col(text_col).cast("binary")))


def hamming_links(prints: DataFrame, *, radius: int = 3) -> DataFrame:
    """Links (a, b) that join the same fingerprints as all pairs within ``radius`` bits do.

    ``prints`` has distinct longs in its first column.  Of the two 32-bit halves
    one differs in at most ``radius // 2`` bits, so each fingerprint looks in
    each half's table at the keys of a Hamming ball; what it finds there is
    compared in full.  Where two keys differ in bits that one of them all has,
    the other finds it by setting bits, so with a radius of one a ball need only
    hold the keys with a bit more; otherwise it is whole.  A bucket
    returns a spanning forest of its links rather than all pairs.  A bucket
    beyond ``BUCKET_ROWS`` is split by the same argument over the quarters of the
    other half, so its parts hold few fingerprints and no link is lost.
    """
    x = prints.columns[0]
    each = radius // 2
    prints = prints.select(F.col(x).alias("x"))
    low = F.col("x").bitwiseAND(0xFFFFFFFF)
    # a key is 33 bits: the table, and a half
    halves = prints.select("x", F.explode(F.array(F.shiftrightunsigned("x", 32), low.bitwiseOR(1 << 32))).alias("k"))
    probes = halves.select(F.explode(ball("k", 32, each, upper=each == 1)).alias("k"), "x")
    # keys that own nothing can't give a link: a prober stays only beside an owner of the key
    owners = halves.groupBy("k").agg(F.count("*").alias("owners"))
    met = probes.join(owners, "k", "left_semi")
    size = met.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    met = met.join(size, "k")
    small = met.filter(F.col("n") <= BUCKET_ROWS).select("k", F.lit(0).alias("u"), F.lit(0).cast("long").alias("q"), "x")
    other = F.when(F.col("k") < (1 << 32), low).otherwise(F.shiftrightunsigned("x", 32))
    large = met.filter(F.col("n") > BUCKET_ROWS).select("k", "x", F.explode(F.array(
        F.struct(F.lit(1).alias("u"), F.shiftright(other, 16).alias("q")),
        F.struct(F.lit(2).alias("u"), other.bitwiseAND(0xFFFF).alias("q")),
    )).alias("e")).select("k", "e.u", "e.q", "x")
    large = large.select("k", "u", F.explode(ball("q", 16, each)).alias("q"), "x")

    def forests(batches):
        """Tasks over buckets in key order, one held at a time."""
        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, u, q, x = (np.asarray(c) for c in batch.columns)
            first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (u[1:] != u[:-1]) | (q[1:] != q[:-1]))))
            links = []
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(k)], strict=True):
                now = (k[i], u[i], q[i])
                if now != name:
                    links += forest(held)
                    held, name = [], now
                held.append(x[i:j].copy())
            if links:
                yield pack(links)
        links = forest(held)
        if links:
            yield pack(links)

    def forest(held):
        values = held[0] if len(held) == 1 else np.concatenate(held) if held else []
        return spanning_links(np.unique(values), radius) if len(values) > 1 else []

    def pack(links):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    keys = ["k", "u", "q"]
    return small.union(large).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(forests, "a long, b long").distinct()


def ball(key: str, bits: int, radius: int, upper: bool = False):
    """All keys within ``radius`` bits of an unsigned ``bits``-wide key, as an array column; ``upper``: that have all its bits."""
    from itertools import combinations

    masks = [sum(1 << i for i in flip) for r in range(radius + 1) for flip in combinations(range(bits), r)]
    masks = F.array(*[F.lit(m).cast("long") for m in masks])
    if upper:
        masks = F.filter(masks, lambda m: F.col(key).bitwiseAND(m) == 0)
    return F.transform(masks, lambda m: F.col(key).bitwiseXOR(m))


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links values within ``radius`` bits.

    Breadth first: each visited value is compared with all that are not yet
    visited, so a dense bucket is done after a few comparisons.
    """
    rest, links = values.view(np.uint64), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                links += [(int(x.view(np.int64)), int(y)) for y in found.view(np.int64)]
                queue += list(found)
                rest = rest[~near]
    return links


def fingerprint_components(rows: DataFrame, *, radius: int = 3) -> DataFrame:
    """(fingerprint, component_id, first_fingerprint) of a materialised table (doc_id, fingerprint).

    ``first_fingerprint`` is the fingerprint of the component's smallest id, so
    id and fingerprint together say which row stands for it.
    """
    classes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    links = cut(hamming_links(classes.select("fingerprint"), radius=radius), "simhash-links")
    parts = connected_components(links)
    joined = classes.join(parts, classes.fingerprint == parts.node, "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    least = F.min(F.struct(F.col("first").isNull(), "first", "fingerprint"))
    named = joined.groupBy("component").agg(least.alias("m")).select("component", F.col("m.first").alias("component_id"), F.col("m.fingerprint").alias("first_fingerprint"))
    return joined.join(named, "component").select("fingerprint", "component_id", "first_fingerprint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: id, ``fingerprint`` (long) and ``component_id``.

    Fingerprints within ``radius`` bits are linked; a component is what links
    reach, named by its smallest id.  Documents with equal fingerprints are one
    class before any comparison, so a group of copies costs one fingerprint and
    large groups are only counted map-side.

    Null, empty and wordless texts have fingerprint 0 and link like any other;
    repeated ids keep a row each; null ids stay null and never name a component
    unless all its ids are null; an empty table gives an empty result.  Other
    columns are not read.
    """
    rows = cut(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words=words).drop("text"), "simhash")
    verdict = fingerprint_components(rows, radius=radius).drop("first_fingerprint")
    return rows.join(verdict, "fingerprint").select(F.col("doc_id").alias(id_col), "fingerprint", "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """The documents without near duplicates: of each component the one of smallest id.

    All columns stay as they are.  Of repeated rows with that id and fingerprint
    one stays; of documents that all lack an id, one with the smallest
    fingerprint.  Fingerprints are computed once; a 128-bit hash of id and text
    then names the row that stays.
    """
    a, b = unused(docs, "row_a"), unused(docs, "row_b")
    name = [F.xxhash64(id_col, text_col), F.xxhash64(F.lit(1), text_col, id_col)]
    printed = with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), name[0].alias("a"), name[1].alias("b"), F.col(text_col).alias("text")), words=words)
    rows = cut(printed.drop("text"), "simhash")
    heads = fingerprint_components(rows, radius=radius).filter("fingerprint = first_fingerprint").select("fingerprint", "component_id")
    heads = rows.join(heads, "fingerprint").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = heads.groupBy("fingerprint").agg(F.min(F.struct("a", "b")).alias("row")).select(F.col("row.a").alias(a), F.col("row.b").alias(b))
    first = docs.withColumns({a: name[0], b: name[1]}).join(heads, [a, b], "left_semi")
    return first.dropDuplicates([a, b]).select(*docs.columns)
