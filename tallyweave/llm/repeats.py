"""Repeated substrings across documents, by a suffix array over sampled positions.

Every ``width``-byte string has, among its ``GRAM``-byte grams, one of least
hash (the first of several); wherever the string occurs that gram is at the same
place in it.  So a suffix array over these anchors only, split by their first
``GRAM`` bytes, sees every repeat of ``width`` bytes or more:

1. anchors are counted by gram and by their whole surroundings (what any
   ``width``-byte string around them can reach).  Equal surroundings are repeats
   as a whole; grams that occur once are none; both need no text to move.
2. Where surroundings of one gram differ, at the edges of repeats, the anchor's
   suffixes are sorted, their common prefixes make an interval tree, and a scan
   with a stack visits its intervals.  In each, the members' left extensions are
   compared: where they differ or agree tells how far each member's repeat
   reaches.  All occurrences of an interval are reported, not just neighbours.
3. A gram with many different surroundings is split: the strings that have the
   gram at places lo to hi share lo bytes before it and all but hi after it, so
   members that differ there have none of these strings in common.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, release_memory, slices

GRAM = 64
#: Bytes of text hashed in one vectorised step (positions have 24 bits there).
CHUNK = 1_000_000
#: Surroundings that are compared as one class; a larger class is split by what its members share.
CLASS_ROWS = 1_000
#: Into how many a class is split, and parts that the rows of a large class are dealt into.
SPLIT, SALTS = 6, 64

# kinds of rows on the way: one occurrence, several (one shown), a span, an edge alone or for several, and "this gram varies"
ONE, SEVERAL, SPAN, EDGE, EDGES, VARIES = range(6)
_TABLE = np.random.default_rng(64).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)]
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling."""
    g, step = _TABLE[raw], 1
    for odd in _ODD:
        g = g[:-step] * odd + g[step:]
        step *= 2
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32))


def anchors(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all ``width``-byte strings within the texts raw[at[i]:at[i+1]]."""
    g = gram_hashes(raw)
    least = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
    span, grams = 1, width - GRAM + 1
    while span * 2 <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < grams:
        least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
    inside = np.zeros(len(raw) + 1, np.int8)
    whole = np.diff(at) >= width
    np.add.at(inside, at[:-1][whole], 1)
    np.add.at(inside, at[1:][whole] - width + 1, -1)
    inside = np.cumsum(inside[: len(least)], dtype=np.int8).astype(bool)
    place = (least & _PLACE).astype(np.int64)
    new = np.concatenate(([True], (place[1:] != place[:-1]) | ~inside[:-1]))
    found = np.unique(place[inside & new])
    return found, g[found].view(np.int64)


def text_anchors(raw: np.ndarray, at: np.ndarray, width: int):
    """(text number, position, hash) of all anchors of many texts, in steps of bounded size."""
    owner, places, hashes = [], [], []
    size = np.diff(at)
    for a, b in slices(size.tolist(), CHUNK):
        if size[a:b].max() < width:
            continue
        begin, end = at[a], at[b]
        if b - a == 1 and end - begin > 2 * CHUNK:  # one long text: overlapping parts hold each string once
            got = []
            for lo in range(begin, end - width + 1, CHUNK):
                part = raw[lo : min(end, lo + CHUNK + width - 1)]
                p, h = anchors(part, np.array([0, len(part)]), width)
                got.append((p + lo, h))
            p, h = (np.concatenate(x) for x in zip(*got, strict=True))
            p, first = np.unique(p, return_index=True)
            h = h[first]
        else:
            if end - begin < GRAM:
                continue
            p, h = anchors(raw[begin:end], at[a : b + 1] - begin, width)
            p = p + begin
        places.append(p)
        hashes.append(h)
        owner.append(np.searchsorted(at, p, side="right") - 1)
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owner), np.concatenate(places), np.concatenate(hashes)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys, in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


FOUND = "h long, kind byte, ctx long, r1 long, r2 long, a int, b int"
FOUND_TYPES = [pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def found_batch(h, kind, ctx, r1, r2, a, b):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((h, kind, ctx, r1, r2, a, b), FOUND_TYPES, strict=True)], ["h", "kind", "ctx", "r1", "r2", "a", "b"])


def anchor_rows(width: int):
    """Tasks over (r1, r2, text): what each batch of texts has to say about grams.

    Within a batch the occurrences of a gram with equal surroundings are one
    row and spans; where the surroundings vary, they are edges at once and the
    gram gets one row that says so.  A gram thus sends at most two rows per batch
    under its own key, however many documents share it.
    """
    import xxhash

    back = width - GRAM

    def run(batches):
        for batch in batches:
            raw, at = byte_column(batch.column(2))
            owner, p, h = text_anchors(raw, at, width)
            if not len(p):
                continue
            lo, hi = np.maximum(p - back, at[owner]), np.minimum(p + width, at[owner + 1])
            view = memoryview(raw)
            digest = xxhash.xxh64_intdigest
            ctx = np.fromiter((digest(view[x:y], z) for x, y, z in zip(lo.tolist(), hi.tolist(), (p - lo).tolist(), strict=True)), np.uint64, len(p)).view(np.int64)
            order = np.lexsort((ctx, h))
            owner, p, h, lo, hi, ctx = (x[order] for x in (owner, p, h, lo, hi, ctx))
            start = at[owner]
            r1, r2 = np.asarray(batch.column(0))[owner], np.asarray(batch.column(1))[owner]
            same = runs(h, ctx)
            times = np.diff(np.append(same, len(h)))
            grams = runs(h[same])
            kinds = np.diff(np.append(grams, len(same)))
            varies = np.repeat(kinds > 1, kinds)
            repeated = np.repeat(times > 1, times)
            # what is sure already: spans, under a key that spreads them
            yield found_batch(r1[repeated], np.full(repeated.sum(), SPAN), ctx[repeated], r1[repeated], r2[repeated], (lo - start)[repeated], (hi - start)[repeated])
            shape = (p - lo) * 256 + (hi - p)
            kind = np.where(varies, np.where(times > 1, EDGES, EDGE), np.where(times > 1, SEVERAL, ONE))
            first = same
            key = np.where(varies, r1[first] ^ h[first], h[first])
            # an edge keeps its gram in ctx, as its key only spreads it
            yield found_batch(key, kind, np.where(varies, h[first], ctx[first]), r1[first], r2[first], (p - start)[first], shape[first])
            told = h[same[grams[kinds > 1]]]
            zero = np.zeros(len(told), np.int64)
            yield found_batch(told, np.full(len(told), VARIES), zero, zero, zero, zero, zero)
            del order, owner, p, h, lo, hi, ctx, start, r1, r2
            release_memory()

    return run


def judge(batches):
    """Tasks over rows sorted by h: spans and edges; a gram's rows (two a batch of texts at most) are held until the next gram."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [np.asarray(c) for c in batch.columns]
        if not len(now[0]):
            continue
        last = now[0][-1]
        if held and held[-1][0][-1] == last:
            held.append(now)
            continue
        cut = int(np.searchsorted(now[0], last, side="left"))
        held.append([x[:cut] for x in now])
        done = [np.concatenate(x) for x in zip(*held, strict=True)]
        held = [[x[cut:].copy() for x in now]]
        if len(done[0]):
            yield judged(done)
    if held:
        yield judged([np.concatenate(x) for x in zip(*held, strict=True)])


def judged(columns):
    h, kind, ctx, r1, r2, a, b = columns
    passing = np.isin(kind, (SPAN, EDGE, EDGES))
    out = [[ctx[passing], kind[passing], np.zeros(passing.sum(), np.int64), r1[passing], r2[passing], a[passing], b[passing]]]
    told = np.unique(h[kind == VARIES])
    own = (kind == ONE) | (kind == SEVERAL)
    h, kind, ctx, r1, r2, a, b = (x[own] for x in (h, kind, ctx, r1, r2, a, b))
    if len(h):
        order = np.lexsort((ctx, h))
        h, kind, ctx, r1, r2, a, b = (x[order] for x in (h, kind, ctx, r1, r2, a, b))
        same = runs(h, ctx)
        sizes = np.diff(np.append(same, len(h)))
        times = np.add.reduceat(np.where(kind == SEVERAL, 2, 1), same)
        grams = runs(h[same])
        kinds = np.diff(np.append(grams, len(same)))
        varies = np.repeat(kinds > 1, kinds) | np.isin(h[same], told)
        repeated = np.repeat(times > 1, sizes)
        zero = np.zeros(len(h), np.int64)
        out.append([h[repeated], np.full(repeated.sum(), SPAN), zero[repeated], r1[repeated], r2[repeated], (a - b // 256)[repeated], (a + b % 256)[repeated]])
        edge = same[varies]
        out.append([h[edge], np.where(times[varies] > 1, EDGES, EDGE), zero[edge], r1[edge], r2[edge], a[edge], b[edge]])
    return found_batch(*(np.concatenate(x) for x in zip(*out, strict=True)))


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    bits = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (bits.bit_length() + 7) // 8


def prefix_intervals(prefixes: list[int]):
    """Intervals (first, last, common prefix) of the tree over a sorted suffix list; prefixes[i] joins i and i + 1."""
    stack: list[tuple[int, int]] = []  # first member, common prefix
    for i, n in enumerate([*prefixes, -1]):
        first = i
        while stack and stack[-1][1] > n:
            first, depth = stack.pop()
            yield first, i, depth
        if n >= 0 and (not stack or stack[-1][1] < n):
            stack.append((first, n))


def maximal_repeats(members: list[tuple[bytes, bytes, int]], width: int):
    """Reaches (member, bytes before, bytes from the anchor on) of the repeats of one gram's members.

    A member is (text before the anchor reversed, text from it on, occurrences).
    A repeat of an interval is as long as the common prefix and as far to the
    left as some two members agree; only those of ``width`` bytes count.
    """
    alike: dict[tuple[bytes, bytes], list[int]] = {}
    for i, (before, after, _) in enumerate(members):
        alike.setdefault((before, after), []).append(i)
    for (before, after), same in alike.items():
        if sum(members[i][2] for i in same) > 1:
            for i in same:
                yield i, len(before), len(after)
    if len(alike) < 2:
        return
    order = sorted(alike, key=lambda x: x[1])
    for first, last, depth in prefix_intervals([common_prefix(x[1], y[1]) for x, y in zip(order, order[1:])]):
        group = sorted(order[first : last + 1])
        # left extensions: agreement with either neighbour in the order of the reversed texts before
        agree = [0, *(common_prefix(x[0], y[0]) for x, y in zip(group, group[1:])), 0]
        for k, key in enumerate(group):
            reach = max(agree[k], agree[k + 1])
            if reach + depth >= width:
                for i in alike[key]:
                    yield i, reach, depth


SURROUNDING = "h long, heavy boolean, lo int, hi int, before binary, after binary, times int, r1 long, r2 long, a int"
PART = "key binary, whole binary, lo int, hi int, before binary, after binary, times int, r1 long, r2 long, a int"


def rows_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def surroundings(width: int):
    """Tasks over (text, r1, r2, edges): the bytes around each edge of a text."""
    back = width - GRAM

    def run(batches):
        for batch in batches:
            rows = []
            for text, r1, r2, edges in zip(*(batch.column(c) for c in ("text", "r1", "r2", "edges")), strict=True):
                raw, r1, r2 = text.as_buffer(), r1.as_py(), r2.as_py()
                for e in edges.as_py():
                    a = e["a"]
                    lo, hi = max(0, a - back), min(len(raw), a + width)
                    rows.append((e["h"], e["heavy"], 0, back, raw[lo:a].to_pybytes()[::-1], raw[a:hi].to_pybytes(), 2 if e["kind"] == EDGES else 1, r1, r2, a))
                    if len(rows) >= 20_000:
                        yield rows_batch(rows, SURROUNDING)
                        rows = []
            if rows:
                yield rows_batch(rows, SURROUNDING)
            release_memory()

    return run


def narrower(width: int):
    """Tasks over surroundings: a row for each part of the places lo to hi, cut to what strings at these places can reach.

    ``key`` names what all these strings share, ``whole`` the surroundings that are left.
    """
    name = lambda *parts: hashlib.blake2b(b"".join(parts), digest_size=16).digest()

    def run(batches):
        for batch in batches:
            rows = []
            for lo, hi, before, after, *more in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "before", "after", "times", "r1", "r2", "a")), strict=True):
                step = -(-(hi - lo + 1) // SPLIT)
                for first in range(lo, hi + 1, step):
                    last = min(first + step - 1, hi)
                    if len(before) >= first and len(after) >= width - last:
                        x, y = before[:last], after[: width - first]
                        key, whole = name(x[:first][::-1], y[: width - last]), name(len(x).to_bytes(4), x[::-1], y)
                        rows.append((key, whole, first, last, x, y, *more))
                if len(rows) >= 20_000:
                    yield rows_batch(rows, PART)
                    rows = []
            if rows:
                yield rows_batch(rows, PART)
            release_memory()

    return run


SPANS = "r1 long, r2 long, a int, b int"


def interval_spans(width: int, keys: int):
    """Tasks over surroundings sorted by class (the first ``keys`` columns): the spans of its maximal repeats."""

    def spans(group):
        for i, reach, depth in maximal_repeats([g[:3] for g in group], width):
            *_, r1, r2, a = group[i]
            yield r1, r2, a - reach, a + depth

    def run(batches):
        group, name, out = [], None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != row[:keys]:
                    out += spans(group)
                    group, name = [], row[:keys]
                group.append(row[keys:])
                if len(out) >= 20_000:
                    yield rows_batch(out, SPANS)
                    out = []
        out += spans(group)
        if out:
            yield rows_batch(out, SPANS)
        release_memory()

    return run


def heavy_classes(rows: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame | None:
    """Classes of more than ``CLASS_ROWS`` rows, each in ``SALTS`` parts; None if there are none.

    Classes are counted before the shuffle (or in ``counts``, with their size as
    ``m``), and their rows meet the few large ones in parts, so none gathers in a task.
    """
    from .common import cut

    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("m"))
    large = counts.filter(F.col("m") > CLASS_ROWS)
    large = cut(large.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "large-classes")
    return None if large.isEmpty() else large


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod("r1", F.lit(SALTS)).cast("int"))


def with_heavy(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """Add ``heavy``, true for the rows of large classes and else null, and say whether there are any."""
    large = heavy_classes(rows, keys)
    if large is None:
        return rows.withColumn("heavy", F.lit(None).cast("boolean")), False
    return salted(rows).join(large.withColumn("heavy", F.lit(True)), [*keys, "salt"], "left").drop("salt"), True


def class_spans(around: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Spans of the classes that are compared as a whole."""
    rows = around.select(*keys, "before", "after", "times", "r1", "r2", "a")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(interval_spans(width, len(keys)), SPANS)


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """``docs`` as (doc_id, text binary, spans array<struct<a,b>>): what strings of ``width`` bytes that start twice cover.

    Texts are UTF-8 bytes, null is empty.  The spans overlap and are unordered.
    Whole surroundings of anchors are equal if a 64-bit hash of the gram and
    another of the surroundings are, and strings at the last split if 128-bit
    hashes are; everything else is compared byte by byte.
    """
    from .common import cut

    if width < 2 * GRAM:
        raise ValueError(f"width must be at least {2 * GRAM}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    # 128 bits name a row; rows of equal id and text share a name, and equal spans
    rows = rows.withColumns({"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64(F.lit(1), "text", "doc_id")})
    seen = rows.filter(F.octet_length("text") >= width).select("r1", "r2", "text").mapInArrow(anchor_rows(width), FOUND)
    found = cut(seen.repartition("h").sortWithinPartitions("h").mapInArrow(judge, FOUND).select("h", "kind", "r1", "r2", "a", "b"), "repeats")
    edges, some = with_heavy(found.filter(F.col("kind").isin(EDGE, EDGES)).drop("b"), ["h"])
    by_row = edges.groupBy("r1", "r2").agg(F.collect_list(F.struct("h", "a", "kind", "heavy")).alias("edges"))
    around = cut(rows.join(by_row, ["r1", "r2"]).mapInArrow(surroundings(width), SURROUNDING), "surroundings")
    parts = [class_spans(around.filter("heavy IS NULL"), ["h"], width)]
    places = width - GRAM + 1
    while some:  # split the large classes until each has one place, and so one string
        places = -(-places // SPLIT)
        each = cut(around.filter("heavy").mapInArrow(narrower(width), PART), "class-parts")
        # equal surroundings are repeats as a whole, and one of them stands for all from here on
        one = F.first(F.struct("key", "hi", "before", "after", "r1", "r2", "a")).alias("one")
        kept = cut(each.groupBy("whole", "lo").agg(F.count("*").alias("m"), F.sum("times").cast("int").alias("times"), one), "class-parts")
        often = kept.filter((F.col("times") > 1) & (F.col("m") <= CLASS_ROWS)).select("whole", "lo")
        told = each.join(often, ["whole", "lo"], "left_semi")
        large = heavy_classes(each, ["whole", "lo"], kept)
        if large is not None:
            told = told.unionByName(salted(each).join(large, ["whole", "lo", "salt"], "left_semi").drop("salt"))
        parts.append(told.select("r1", "r2", (F.col("a") - F.octet_length("before")).alias("a"), (F.col("a") + F.octet_length("after")).alias("b")))
        if places == 1:
            break
        around, some = with_heavy(kept.select("lo", "times", "one.*"), ["key", "lo"])
        around = cut(around, "class-parts")
        parts.append(class_spans(around.filter("heavy IS NULL"), ["key", "lo"], width))
    spans = found.filter(F.col("kind") == SPAN).select("r1", "r2", "a", "b")
    for part in parts:
        spans = spans.unionByName(part)
    spans = spans.groupBy("r1", "r2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return rows.join(spans, ["r1", "r2"], "left").select("doc_id", "text", "spans")


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of positions that spans cover; touching runs are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """Remove every byte that a repeated string of ``width`` bytes covers.

    A string is repeated if it starts at two places or more, in one text or in
    different ones (rows), overlaps included; strings are judged on the input.
    Returns per row: id, n_bytes, ``removed`` (the maximal runs as an array of
    structs start, end) and ``kept`` (the remaining bytes, not always valid UTF-8).

    Null and short texts lose nothing; of equal texts of ``width`` bytes or more
    all are removed whole; null and repeated ids keep a row each; an empty table
    gives an empty result; other columns are not read.
    """
    found = repeated_spans(docs, id_col=id_col, text_col=text_col, width=width)
    id_type = docs.schema[id_col].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes()
                gone = merged((s["a"], s["b"]) for s in spans.as_py()) if spans.is_valid else []
                ends = [0, *(x for run in gone for x in run), len(raw)]
                rows.append((len(raw), [{"start": a, "end": b} for a, b in gone], b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))))
            if rows:
                types = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", "n_bytes", "removed", "kept"])
                del rows
                release_memory()

    out = found.mapInArrow(apply, f"doc_id {id_type}, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")
    return out.withColumnRenamed("doc_id", id_col)
