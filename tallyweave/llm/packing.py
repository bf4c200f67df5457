"""Best-fit packing of tokenised documents into fixed-length sequences.

Pieces of one length are interchangeable, so the packing is decided on the
histogram of lengths (at most ``capacity`` numbers, whatever the corpus) by bin
completion; each piece then finds its place from its rank within its length.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release_memory

CAPACITY = 2048
#: Pieces of one length that are ranked in one group, and the least number of groups of a length.
GROUP = 50_000
GROUPS = 64
#: White-space characters in a row from which a text goes through ``tokenizers``, as a look-ahead can't be tried at so many places.
LONG_RUN = 100_000


class Encoder:
    """Token ids of the byte-level BPE vocabulary at ``path``, as ``tokenizers`` gives them.

    The same vocabulary runs in ``tiktoken``, which is faster.  Its pattern needs
    a look-ahead only for runs of white space, so texts without such runs take a
    pattern without it, and texts with very long runs ``tokenizers`` itself.  The
    file's added tokens are found in texts first, as ``tokenizers`` does.
    """

    def __init__(self, path: str):
        import json
        import re

        import tiktoken
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, added = content["model"]["vocab"], {x["content"]: x["id"] for x in content["added_tokens"]}
        # the bytes behind the printable characters that byte-level vocabularies are written in
        shown = sorted(pre_tokenizers.ByteLevel.alphabet(), key=ord)
        plain = [c for c in shown if ord(c) < 256]
        byte = {c: ord(c) for c in plain} | dict(zip((c for c in shown if ord(c) >= 256), (b for b in range(256) if chr(b) not in plain), strict=True))
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in added and all(c in byte for c in token)}
        words = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
        self.plain = tiktoken.Encoding("plain", pat_str=words + r"|\s+", mergeable_ranks=ranks, special_tokens=added)
        self.full = tiktoken.Encoding("full", pat_str=words + r"|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens=added)
        self.path, self.slow = path, None
        self.run, self.runs = re.compile(r"\s\s").search, re.compile(r"\s{2,}").finditer

    def __call__(self, text: str) -> list[int]:
        if len(text) >= LONG_RUN and any(r.end() - r.start() >= LONG_RUN for r in self.runs(text)):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return self.slow.encode(text, add_special_tokens=False).ids
        return (self.full if self.run(text) else self.plain).encode(text, allowed_special="all")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise and cut: doc_id, piece, start, length, ids_crc32, and ``ids`` if asked.

    A document's ids end with ``end_id``.  Only those longer than ``capacity``
    are cut; every piece but the first is full.  ``ids`` holds little-endian
    unsigned 32-bit numbers, ``ids_crc32`` their CRC-32.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def pieces(batches):
        encode = encoder(path)
        for batch in batches:
            column, made = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                end = len(ids) - (len(ids) - 1) // capacity * capacity
                start = piece = 0
                while start < len(ids):
                    raw = ids[start:end].tobytes()
                    column.append(i)
                    made.append((piece, start, end - start, zlib.crc32(raw), raw if keep_ids else None))
                    start, end, piece = end, end + capacity, piece + 1
                if len(made) >= 20_000:
                    yield pack(batch, column, made)
                    column, made = [], []
            if made:
                yield pack(batch, column, made)
            release_memory()

    def pack(batch, column, made):
        arrays = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(column, pa.int64())), *arrays], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, ids binary"
    made = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)
    return made if keep_ids else made.drop("ids")


@dataclass
class Filling:
    """Lengths of one sequence, longest first, and how many sequences are filled so."""

    lengths: list[int]
    times: int


def completions(counts: np.ndarray, room: int, largest: int, *, most: int, width: int, steps: int) -> list[list[int]]:
    """Undominated fillings of ``room`` by lengths up to ``largest`` that are left, least waste first.

    Depth first from long to short lengths; fillings that waste over ``most``
    are left out.  One full filling by one length dominates all others.  A
    filling is dominated if one or two of its lengths can be exchanged for a
    single left one that is as long or longer and still fits.  The enumeration
    ends after ``steps`` steps, or with ``width`` fillings without waste.
    """
    left = np.flatnonzero(counts[: room + 1])
    left = left[(left > 0) & (left <= largest)]
    if not len(left):
        return [[]] if room <= most else []
    if left[-1] == room:
        return [[room]]
    below = np.zeros(room + 1, np.int64)
    below[left] = left
    below = np.maximum.accumulate(below).tolist()
    smallest, found, done, full = int(left[0]), [], 0, 0

    def extend(chosen, space, cap):
        nonlocal done, full
        done += 1
        x = below[min(space, cap)] if space > 0 else 0
        while x and chosen.count(x) >= counts[x]:
            x = below[x - 1]
        if not x or space < smallest:
            if space <= most:
                found.append((space, chosen))
                full += space == 0
            return
        while x and done < steps and full < width:
            if chosen.count(x) < counts[x]:
                extend([*chosen, x], space - x, x)
            x = below[x - 1]

    extend([], room, room)

    def dominated(space, chosen):
        lots = {*chosen} | {a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :]}
        return any((y := below[min(t + space, room)]) >= t and y not in chosen and (y > t or t not in chosen) for t in lots)

    best = sorted((x for x in found if not dominated(*x)), key=lambda x: (x[0], len(x[1]), [-n for n in x[1]]))[:width]
    return [chosen for _, chosen in best or sorted(found, key=lambda x: (x[0], len(x[1])))[:1]]


def best_fit(counts: np.ndarray, capacity: int) -> list[Filling]:
    """Best-fit decreasing on a histogram of lengths: each item goes where it leaves the least room.

    Bins filled alike are one group, and equal items are placed group by group.
    """
    rooms: dict[int, list[Filling]] = {}
    open_rooms: list[int] = []  # sorted

    def add(room, group):
        if room not in rooms:
            bisect.insort(open_rooms, room)
        rooms.setdefault(room, []).append(group)

    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        while left:
            at = bisect.bisect_left(open_rooms, n)
            if at == len(open_rooms):  # no bin has room: new ones
                each = min(capacity // n, left)
                add(capacity - each * n, Filling([n] * each, left // each))
                left -= left // each * each
                continue
            room = open_rooms[at]
            group = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], open_rooms[at]
            each = min(room // n, left)
            times = min(group.times, left // each)
            if times < group.times:
                add(room, Filling(group.lengths, group.times - times))
            add(room - each * n, Filling(group.lengths + [n] * each, times))
            left -= times * each
    return [f for groups in rooms.values() for f in groups]


def bins_needed(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins for a histogram of lengths.

    For each length a up to half a bin: items that leave less than a need a bin
    alone; others over half need one each, and what is between a and half fits at
    best into what these leave.
    """
    n, half = len(counts), capacity // 2
    number = np.concatenate(([0], np.cumsum(counts)))
    volume = np.concatenate(([0], np.cumsum(counts * np.arange(n))))
    top = int(number[n] - number[half + 1])
    a = np.arange(half + 1)
    beside = volume[capacity - a + 1] - volume[half + 1], number[capacity - a + 1] - number[half + 1]
    rest = volume[half + 1] - volume[a] - (beside[1] * capacity - beside[0])
    return top + max(0, int((-(-rest // capacity)).max()))


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, *, width: int = 12, steps: int = 720, nodes: int = 1_500) -> list[Filling]:
    """Pack ``counts[n]`` items of each length n into as few bins as the search finds.

    Branch and bound: the best-fit solution is the first incumbent.  A node fills
    bins around the longest length left, as often as the counts allow; fillings
    that waste more than a better solution may waste are pruned, and so is a branch
    whose bins and bound on the rest reach the incumbent.  The search
    ends at the lower bound, or when a descent has reached its end and ``nodes``
    further nodes were looked at; a node tries at most ``width`` fillings, found in ``steps``
    steps.  Every item is packed in any case, and never in more bins than best fit takes.
    """
    counts = np.zeros(capacity + 1, np.int64) + np.pad(np.asarray(counts, np.int64), (0, capacity + 1 - len(counts)))
    total = int((counts * np.arange(capacity + 1)).sum())
    best = best_fit(counts, capacity)
    best_bins = sum(f.times for f in best)
    least = bins_needed(counts, capacity)
    # depth first with an explicit stack: the fillings made on the way to a node, its bins and waste, and the fillings still to try there
    stack = [(counts, (), 0, 0, None)] if best_bins > least else []
    # nodes count from the end of the first descent, which takes one per filling
    visited, descended = 0, False
    while stack and not (descended and visited > nodes):
        left, made, bins, waste, options = stack.pop()
        # a solution with one bin less may waste this much
        most = (best_bins - 1) * capacity - total - waste
        dead = most < 0 or bins + bins_needed(left, capacity) >= best_bins
        if not dead and not left.any():
            best, best_bins, dead, path = [], bins, True, made
            while path:
                filling, path = path
                best.append(filling)
            if bins == least:
                break
        if not dead and options is None:
            longest = int(np.flatnonzero(left)[-1])
            rest = left.copy()
            rest[longest] -= 1
            options = [[longest, *x] for x in completions(rest, capacity - longest, longest, most=most, width=width, steps=steps)]
            dead = not options
        if dead:
            visited, descended = visited * descended, True
            continue
        visited += 1
        lengths, *others = options
        if others:
            stack.append((left, made, bins, waste, others))
        used, each = np.unique(lengths, return_counts=True)
        times = int((left[used] // each).min())
        spare = capacity - sum(lengths)
        if spare:  # as often as the waste allows, or once, to be pruned by it
            times = max(1, min(times, most // spare))
        after = left.copy()
        after[used] -= each * times
        stack.append((after, (Filling(lengths, times), made), bins + times, waste + spare * times, None))
    return best


def places(fillings: list[Filling]) -> pd.DataFrame:
    """For each filling and length in it: the ranks it takes, the first sequence, the place in the sequence."""
    rows, ranks, sequence = [], {}, 0
    for f in fillings:
        offset = 0
        for n in dict.fromkeys(f.lengths):
            each = f.lengths.count(n)
            rows.append((n, ranks.get(n, 0), each, sequence, offset))
            ranks[n] = ranks.get(n, 0) + each * f.times
            offset += n * each
        sequence += f.times
    return pd.DataFrame(rows, columns=["length", "rank", "each", "sequence", "offset"]).astype(np.int64).sort_values(["length", "rank"], ignore_index=True)


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32"), width: int = 12, steps: int = 720, nodes: int = 1_500) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a materialised table with a long ``length`` from 1 to ``capacity``.

    The driver receives one count per length.  Ranks within a length are counted
    in groups of it, as many as its count asks for, and shifted by the sizes of
    the groups before, so no length gathers in one task.  ``width``, ``steps``
    and ``nodes`` bound the search of :func:`bin_completion`, not what is packed.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    table = places(bin_completion(counts, capacity, width=width, steps=steps, nodes=nodes))
    keys, rank, each, sequence, offset = (table[c].to_numpy() for c in table.columns)
    groups_of = F.element_at(F.lit((-(-counts // GROUP)).clip(min=GROUPS).tolist()), F.col("length").cast("int") + 1)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), groups_of))
    groups = cut(salted.groupBy("length", "__salt").agg(F.count("*").alias("n")), "pack-groups")
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = groups.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"))
    numbered = salted.withColumn("__n", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1)
    ranked = numbered.join(shift, ["length", "__salt"]).withColumn("__rank", F.col("__shift") + F.col("__n"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, at: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), at.to_numpy()
        first, last = np.searchsorted(keys, n, side="left"), np.searchsorted(keys, n, side="right")
        # bisect within each length's rows, all pieces at a time
        while (last - first > 1).any():
            mid = (first + last) // 2
            up = (rank[mid.clip(max=len(rank) - 1)] <= r) & (last - first > 1)
            first, last = np.where(up, mid, first), np.where(~up & (last - first > 1), mid, last)
        k = r - rank[first]
        return pd.DataFrame({"sequence_id": sequence[first] + k // each[first], "offset": offset[first] + k % each[first] * n})

    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return ranked.select(*names, place("length", "__rank").alias("__at")).select(*names, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, path: str, *, capacity: int = CAPACITY, keep_ids: bool = False, width: int = 12, steps: int = 720, nodes: int = 1_500, **options) -> DataFrame:
    """Tokenise, cut and pack whole documents into sequences of at most ``capacity`` tokens.

    Added tokens of the vocabulary that a text spells out get their ids.
    ``width``, ``steps`` and ``nodes`` bound the search for fewer sequences than
    best fit gives (see :func:`bin_completion`); everything is packed in any case.

    Returns per piece: doc_id, piece, start, length, ids_crc32, (ids,)
    sequence_id, offset.  Sequences are gapless from offset 0.  Null and empty
    texts are one token (the end id); repeated rows and ids are packed once per
    row; null ids stay null; an empty table gives an empty result; other columns
    are not read.
    """
    return pack_pieces(cut(token_pieces(docs, path, capacity=capacity, keep_ids=keep_ids, **options), "pieces"), capacity=capacity, width=width, steps=steps, nodes=nodes)
