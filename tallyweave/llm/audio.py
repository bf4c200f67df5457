"""Chroma audio fingerprints of media columns, and their alignment.

Audio becomes frames of energy in the twelve pitch classes.  Filters that
compare areas of this image, read off an integral image, give two bits each,
packed into one 32-bit integer per frame.  Recordings that share the upper bits of
two integers, up to two bits, vote for offsets in a histogram; at these offsets the bit errors decide.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .simhash import ball

RATE = 4000
FRAME = 1024
HOP = 500
#: Frames that one integer looks at.
SPAN = 16
LOWEST, HIGHEST = 110.0, 1760.0
#: Filter outputs are cut at these values into four levels, Gray-coded.
LEVELS = (-0.15, 0.0, 0.15)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: The upper bits of the filters: whether an output is above the middle level.
UPPER = 0xAAAAAAAA
#: Sixteen filters (kind, first pitch class, pitch classes, frames): all kinds, over growing areas.
FILTERS = [(i % 6, (5 * i) % (13 - h), h, w) for i, (h, w) in enumerate((h, w) for w in (4, 8, 12, 16) for h in (3, 6, 9, 12))]


def decode_wav(data: bytes | None) -> np.ndarray:
    """Samples of a PCM WAV file as mono floats at ``RATE``; empty if there is none to read."""
    try:
        with wave.open(io.BytesIO(data or b"")) as file:
            width, channels, rate = file.getsampwidth(), file.getnchannels(), file.getframerate()
            raw = file.readframes(file.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        samples = np.frombuffer(raw, np.uint8).astype(np.float32) - 128
    elif width in (2, 4):
        samples = np.frombuffer(raw, f"<i{width}").astype(np.float32)
    else:
        return np.zeros(0, np.float32)
    samples = samples.reshape(-1, channels).mean(axis=1) / float(1 << (8 * width - 1))
    if rate == RATE or not len(samples):
        return samples
    return np.interp(np.arange(0, len(samples), rate / RATE), np.arange(len(samples)), samples).astype(np.float32)


def pitch_classes() -> np.ndarray:
    """Which FFT bin counts for which pitch class (bins x 12)."""
    bins = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (bins >= LOWEST) & (bins <= HIGHEST)
    table = np.zeros((len(bins), 12), np.float32)
    table[np.flatnonzero(use), np.round(12 * np.log2(bins[use] / 440)).astype(int) % 12] = 1
    return table


_CLASSES = pitch_classes()
_WINDOW = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12 energies, smoothed over five frames, each frame of unit length (or silent)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = [np.zeros((0, 12))]
    for i in range(0, len(frames), 512):
        spectrum = np.fft.rfft(frames[i : i + 512] * _WINDOW, axis=1)
        out.append((spectrum.real**2 + spectrum.imag**2) @ _CLASSES)
    energy = np.concatenate(out)
    if len(energy) < 5:
        return np.zeros((0, 12))
    weights = (0.25, 0.75, 1.0, 0.75, 0.25)
    energy = sum(w * energy[i : len(energy) - 4 + i] for i, w in enumerate(weights))
    length = np.sqrt((energy**2).sum(axis=1, keepdims=True))
    return np.where(length > 1e-6, energy / np.maximum(length, 1e-6), 0.0)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each ``SPAN`` successive frames of a chroma image."""
    count = len(image) - SPAN + 1
    if count <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)

    def area(x, y, w, h):
        a, b = total[x : x + count], total[x + w : x + w + count]
        return b[:, y + h] - a[:, y + h] - b[:, y] + a[:, y]

    out = np.zeros(count, np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, y, w, h)
        if kind == 0:
            part, rest = whole, np.full(count, w * h * 0.2)
        elif kind == 1:
            part = area(0, y, w, h // 2)
            rest = whole - part
        elif kind == 2:
            part = area(0, y, w // 2, h)
            rest = whole - part
        elif kind == 3:
            part = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w - w // 2, h - h // 2)
            rest = whole - part
        elif kind == 4:
            part = area(0, y + h // 3, w, h // 3)
            rest = (whole - part) / 2
        else:
            part = area(w // 4, y, w // 2, h)
            rest = whole - part
        value = np.log((1 + part) / (1 + rest))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(LEVELS, value, side="right")]
    return out


def with_fingerprint(recordings: DataFrame, *, audio_col: str = "audio", decode: Callable[..., np.ndarray] = decode_wav, more: tuple[str, ...] = ()) -> DataFrame:
    """Add ``prints`` (array<long>): the integers of the audio in a column.

    ``decode`` turns a value of ``audio_col`` (and of the columns ``more``) into
    samples at ``RATE``.  Null, undecodable and too short audio has no integers.
    Integers of silent or unchanging frames are kept like any other.  Repeated
    rows get equal integers; an existing ``prints`` column is replaced; an empty table gives an empty result.
    """

    @F.pandas_udf("array<long>")
    def of(*columns: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(chroma(decode(*row))).astype(np.int64) for row in zip(*columns, strict=True)], dtype=object)

    return recordings.withColumn("prints", of(audio_col, *more))


def landmarks(prints: str) -> Column:
    """Integers with their places, where a run of equal ones starts: silence and steady tones are one each."""
    places = F.transform(prints, lambda x, i: F.struct(i.alias("at"), x.alias("word")))
    return F.filter(places, lambda p: (p["at"] == 0) | (F.get(prints, p["at"] - 1) != p["word"]))


def pairs(prints: str, gap: int, name: int = 0) -> Column:
    """Keys of the upper bits of two integers ``gap`` frames apart, 32 together, below a ``name``; with the place of the first, where a run of equal pairs starts."""
    if not gap:
        return landmarks(prints)
    upper = lambda x: x.bitwiseAND(F.lit(UPPER))
    places = F.transform(F.slice(prints, gap + 1, F.size(prints)), lambda y, i: F.struct(i.alias("at"), upper(F.get(prints, i)).bitwiseOR(F.shiftright(upper(y), 1)).bitwiseOR(F.lit(name << 32)).alias("word")))
    moved = lambda at: F.get(prints, at - 1) != F.get(prints, at)
    return F.filter(places, lambda p: (p["at"] == 0) | moved(p["at"]) | moved(p["at"] + gap))


def signed(prints: Column) -> Column:
    """The integers in four bytes each, the highest bit turned: two of them differ in the same bits."""
    return F.transform(prints, lambda x: (x - 2**31).cast("int"))


#: Integers of all queries that are broadcast to where the votes are counted; more are met by a shuffle.
MOST_INTEGERS = 8_000_000


def align(prints: DataFrame, is_query, *, id_col: str = "id", least_votes: int = 1, least_overlap: int = 16, max_error: float = 0.2, flips: int = 2) -> DataFrame:
    """Align query recordings with all recordings by their integers.

    ``prints`` has an id and ``prints``; ``is_query`` is a condition on it.  One
    row per recording: id, ``class_id`` (smallest id with the same integers),
    n_prints, ``n_links`` (other query recordings aligned with it), and for the
    query class that fits best ``best_query`` (its smallest query id), ``shift``
    (frames by which the query starts later in it), ``overlap`` and ``bit_error``.

    Two integers of a query, three quarters of ``least_overlap`` and all of it apart, vote
    for an offset with every such two of other recordings whose upper bits differ in at
    most ``flips`` of 32: links agree in these bits far more often than in the lower
    ones, and integers so far apart share few frames.  Single integers vote for those
    that differ in a bit less.  A
    link without ``least_votes`` at an offset is missed: of links up to an error of 0.2
    two flips find over 0.9, and of those up to 0.14 one flip does (a sixteenth of the probes).  At each offset with
    ``least_votes`` or more, classes link if at least
    ``least_overlap`` integers overlap there and at most ``max_error`` of their
    bits differ; the offset with least errors counts.  Recordings with equal integers are compared once, as a class,
    and a run of equal integers votes by its start.  Recordings without integers
    align with none; null ids are never best; repeated rows are recordings of
    their own; very long recordings are aligned whole; other columns are not
    read, whatever their names; an empty table gives an empty result.
    """
    rows = prints.select(F.col(id_col).alias("id"), "prints", is_query.alias("q"))
    name = F.concat(F.hex(F.xxhash64("prints")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "prints")))
    rows = cut(rows.withColumn("c", F.when(F.size("prints") > 0, name)), "prints")
    classes = rows.filter("c IS NOT NULL").groupBy("c").agg(F.min("id").alias("class_id"), F.first("prints").alias("prints"), F.count_if("q").alias("queries"), F.min(F.when(F.col("q"), F.col("id"))).alias("query_id"))
    classes = cut(classes, "print-classes")
    # votes per pair and offset; a class that is compared with itself needs none
    asked = classes.filter("queries > 0")
    gaps = sorted({0, least_overlap * 3 // 4, least_overlap - 1})
    keys = F.concat(*[pairs("prints", gap, name) for name, gap in enumerate(gaps)])
    words = classes.select("c", F.size("prints").alias("n"), F.inline(keys)).withColumnRenamed("word", "x")
    sought = asked.select(F.col("c").alias("qc"), F.size("prints").alias("q_n"), F.inline(keys))
    sought = sought.select("qc", "q_n", F.col("at").alias("q_at"), F.explode(F.when(F.col("word") < 2**32, ball("word", 32, max(flips - 1, 0))).otherwise(ball("word", 32, flips))).alias("x"))
    shift = F.col("at") - F.col("q_at")
    overlap = F.least(F.col("n"), F.col("q_n") + shift) - F.greatest(F.lit(0), shift)
    # the probes are many times their table, which Spark would broadcast by its size
    votes = words.join(sought.hint("merge"), "x").filter(F.col("c") != F.col("qc")).filter(overlap >= least_overlap).groupBy("c", "qc", shift.alias("shift")).agg(F.count("*").alias("votes"))
    # the integers of a pair of classes meet once, for all of its offsets
    voted = votes.filter(F.col("votes") >= least_votes).groupBy("c", "qc").agg(F.collect_list("shift").alias("shifts"))
    integers = asked.agg(F.sum(F.size("prints"))).first()[0] or 0
    theirs = asked.select(F.col("c").alias("qc"), signed(F.col("prints")).alias("y"), "queries", "query_id")
    both = voted.join(classes.select("c", signed(F.col("prints")).alias("x")), "c").join(F.broadcast(theirs) if integers <= MOST_INTEGERS else theirs, "qc")

    def at(shift: Column) -> Column:
        overlap = F.least(F.size("x"), F.size("y") + shift) - F.greatest(F.lit(0), shift)
        aligned = F.zip_with(F.slice("x", F.greatest(shift, F.lit(0)) + 1, overlap), F.slice("y", F.greatest(-shift, F.lit(0)) + 1, overlap), lambda a, b: F.bit_count(a.bitwiseXOR(b).cast("long").bitwiseAND(F.lit(2**32 - 1))))
        error = F.aggregate(aligned, F.lit(0), lambda n, x: n + x) / (32.0 * overlap)
        return F.when(overlap >= least_overlap, F.struct(error.alias("bit_error"), (-overlap).alias("less"), F.abs(shift).alias("far"), shift.alias("shift")))

    best = F.array_min(F.filter(F.transform("shifts", at), lambda x: x["bit_error"] <= max_error))  # the fewest errors
    both = both.withColumn("b", best).filter("b IS NOT NULL").select("c", "qc", "b.shift", (-F.col("b.less")).alias("overlap"), "b.bit_error", "queries", "query_id")
    own = asked.select("c", F.col("c").alias("qc"), F.lit(0).alias("shift"), F.size("prints").alias("overlap"), F.lit(0.0).alias("bit_error"), "queries", "query_id")
    linked = both.select("c", "qc", "shift", "overlap", "bit_error", "queries", "query_id").unionByName(own)
    found = linked.groupBy("c").agg(
        F.sum("queries").alias("queries"),
        F.min(F.when(F.col("c") != F.col("qc"), F.struct("bit_error", (-F.col("overlap")).alias("less"), "query_id", "shift"))).alias("other"),
    )
    out = rows.join(classes.select("c", "class_id"), "c", "left").join(found, "c", "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.size("prints").alias("n_prints"),
        (F.coalesce("queries", F.lit(0)) - F.when(F.col("q") & F.col("c").isNotNull(), 1).otherwise(0)).alias("n_links"),
        F.col("other.query_id").alias("best_query"), F.col("other.shift").alias("shift"), (-F.col("other.less")).alias("overlap"), F.col("other.bit_error").alias("bit_error"),
    )


def melody(vector, number) -> np.ndarray:
    """Audio of a vector: for each component one of twelve notes, by where it lies among normal numbers of the vector's size.

    The recording misses the first notes of the melody, how many its number says,
    so that recordings of like vectors start at different places.
    """
    if vector is None or not len(vector):
        return np.zeros(0, np.float32)
    v = np.array(vector, float)
    v = np.where(np.isfinite(v), v, 0.0)
    v = v / max(np.abs(v).max(), 1e-300)
    size = np.sqrt((v * v).mean())
    notes = np.searchsorted(_EDGES, v / size if size else v)
    return _NOTES[notes[0 if number is None or number != number else 3 * (int(number) % 4) :]].reshape(-1)


_EDGES = [NormalDist().inv_cdf(k / 12) for k in range(1, 12)]
_NOTES = np.sin(2 * np.pi * 220 * 2 ** (np.arange(12) / 12)[:, None] * np.arange(HOP) / RATE).astype(np.float32)
