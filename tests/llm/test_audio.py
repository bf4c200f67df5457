import io
import wave

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm import audio

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("audio", T.BinaryType()), T.StructField("class_id", T.StringType())])


def wav(samples, rate=audio.RATE, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes((np.repeat(samples, channels) * 30000).astype("<i2").tobytes())
    return out.getvalue()


def tune(seed, notes=60):
    rng = np.random.default_rng(seed)
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * np.arange(audio.HOP) / audio.RATE) for n in rng.integers(0, 24, notes)])


def test_area_filters_match_plain_sums():
    image = np.random.default_rng(1).random((20, 12))
    got = audio.fingerprint(image)
    for t in range(len(got)):
        word = 0
        for kind, y, h, w in audio.FILTERS:
            s = lambda x, r, n, m: image[t + x : t + x + n, r : r + m].sum()  # noqa: E731, B023
            whole = s(0, y, w, h)
            part = [0, s(0, y, w, h // 2), s(0, y, w // 2, h), s(0, y, w // 2, h // 2) + s(w // 2, y + h // 2, w - w // 2, h - h // 2), s(0, y + h // 3, w, h // 3), s(w // 4, y, w // 2, h)][kind]
            a, b = (whole, w * h * 0.2) if kind == 0 else (part, (whole - part) / 2) if kind == 4 else (part, whole - part)
            value = np.log((1 + a) / (1 + b))
            word = word << 2 | [0, 1, 3, 2][sum(value >= x for x in audio.LEVELS)]
        assert word == got[t]


def test_decoding():
    x = tune(1)
    assert np.allclose(audio.decode_wav(wav(x)), x * 30000 / 32768, atol=1e-3)
    assert len(audio.decode_wav(wav(x, channels=2))) == len(x)
    assert abs(len(audio.decode_wav(wav(x, rate=2 * audio.RATE))) - len(x) / 2) <= 1
    for bad in (None, b"", b"RIFF", b"x" * 100):
        assert len(audio.decode_wav(bad)) == 0


def test_alignment(spark):
    x, noise = tune(1), np.random.default_rng(0).normal(0, 0.05, 40_000)
    y = x + noise[: len(x)]
    made = {0: x, 1: y / abs(y).max(), 2: x[7 * audio.HOP :], 3: tune(2), 50: tune(3), 51: tune(3), 4: x[:100], 100: x}
    rows = [(i, wav(s), "clash") for i, s in made.items()] + [(5, None, None), (6, b"junk", None), (None, wav(x), None)]
    prints = audio.with_fingerprint(spark.createDataFrame(rows, SCHEMA))
    got = {r.id: r for r in audio.align(prints, F.coalesce(F.col("id") % 50 == 0, F.lit(False))).collect()}
    assert len(got) == len(rows)
    assert got[0].class_id == got[100].class_id == got[None].class_id == 0
    assert [got[i].n_links for i in (0, 100, 1, 2, 3, 50, 51, 4, 5, 6, None)] == [1, 1, 2, 2, 0, 0, 1, 0, 0, 0, 2]
    assert (got[1].best_query, got[1].shift) == (0, 0)
    assert (got[2].best_query, got[2].shift) == (0, -7)
    assert got[2].bit_error < 0.02 and got[2].overlap == got[2].n_prints
    assert got[5].n_prints == got[6].n_prints == got[4].n_prints == 0
    # the same alignment by trying every offset of every pair
    made = {r.id: np.array(r.prints, np.int64) for r in prints.filter("id IS NOT NULL").collect()}
    for i, r in got.items():
        errors = []
        for q in (0, 50, 100):
            a, b = made.get(i, made[0]), made[q]
            if len(a) and not np.array_equal(a, b):
                for s in range(-len(b) + 16, len(a) - 15):
                    u, v = a[max(s, 0) :][: len(b) + min(s, 0)], b[max(-s, 0) :][: len(a) - max(s, 0)]
                    n = min(len(u), len(v))
                    if n >= 16:
                        errors.append((np.bitwise_count(u[:n] ^ v[:n]).sum() / 32 / n, q))
        if errors and min(errors)[0] <= 0.1:
            assert r.bit_error == min(errors)[0]


def test_recall_of_distorted_recordings(spark):
    rng = np.random.default_rng(9)
    made = {}
    for k in range(60):
        x = tune(100 + k, 90)
        start = int(rng.integers(0, 20 * audio.HOP))  # not at a frame
        y = x[start : start + int(rng.integers(45, 70)) * audio.HOP]
        y = y + rng.normal(0, [0.1, 0.3, 0.6, 1.0, 1.4][k % 5], len(y)) + 0.3 * (k % 4) / 3 * tune(500 + k, 90)[: len(y)]
        made |= {50 * k: x, 50 * k + 1: y / abs(y).max()}
    made |= {7: np.zeros(40_000), 8: np.zeros(30_000), 9: np.sin(np.arange(50_000) * 0.7), 50 * 60: np.zeros(35_000)}
    prints = audio.with_fingerprint(spark.createDataFrame([(i, wav(s)) for i, s in made.items()], "id long, audio binary")).cache()
    got = [{r.id: r for r in audio.align(prints, F.col("id") % 50 == 0, **o).collect()} for o in ({"max_error": 0.14, "flips": 1}, {})]
    ints = {r.id: np.array(r.prints, np.int64) for r in prints.collect()}
    least = {}
    for i, a in ints.items():
        for q, b in ints.items():
            if q % 50 == 0 and q != i:
                for s in range(16 - len(b), len(a) - 15):
                    u, v = a[max(s, 0) :], b[max(-s, 0) :]
                    n = min(len(u), len(v))
                    if n >= 16:
                        least[i, q] = min(least.get((i, q), 1), np.bitwise_count(u[:n] ^ v[:n]).sum() / 32 / n)
    for most, found in zip((0.14, 0.2), got):
        links = {pair for pair, e in least.items() if e <= most}
        assert len(links) > 25 and all(found[i].n_links <= sum(x == i for x, _ in links) for i in ints)
        assert sum(r.n_links for r in found.values()) >= 0.9 * len(links)
    assert {(50 * k + 1, 50 * k) for k in range(60) if k % 5 < 2} <= links  # the lighter distortions are links
    prints.unpersist()


def test_recall_of_unlike_melodies(spark):
    # errors near the limit all along, as between the query's own recordings
    rng = np.random.default_rng(5)
    ints, links = {}, set()
    for k in range(200):
        x = rng.normal(size=64)
        a, b = (audio.fingerprint(audio.chroma(audio.melody(*v))).astype(np.int64) for v in ((x, 0), (x + rng.normal(0, 0.2, 64), k)))
        ints |= {50 * k: a, 50 * k + 1: b}
        for s in range(16 - len(a), len(b) - 15):
            u, v = b[max(s, 0) :], a[max(-s, 0) :]
            n = min(len(u), len(v))
            if n >= 16 and np.bitwise_count(u[:n] ^ v[:n]).sum() <= 0.2 * 32 * n:
                links.add(50 * k + 1)
    prints = spark.createDataFrame([(i, a.tolist()) for i, a in ints.items()], "id long, prints array<long>")
    got = {r.id: r.n_links for r in audio.align(prints, F.col("id") % 50 == 0).collect()}
    assert len(links) > 50 and sum(got[i] > 0 for i in links) >= 0.9 * len(links)


def test_lower_bits_may_differ_everywhere(spark):
    a = np.random.default_rng(6).integers(0, 2**32, 30)
    rows = [(50, a), (1, a ^ 0x00010155), (2, a[9:] ^ 0x00010155), (3, a[:16] ^ 0x00010155), (4, a[:15])]
    prints = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "id long, prints array<long>")
    got = {r.id: r for r in audio.align(prints, F.col("id") % 50 == 0).collect()}
    assert [got[i].n_links for i in (50, 1, 2, 3, 4)] == [0, 1, 1, 1, 0]
    assert (got[2].shift, got[2].overlap, got[2].bit_error) == (-9, 21, 6 / 32)


def test_pairs_start_runs(spark):
    rows = spark.createDataFrame([(1, [5, 5, 5, 7, 7, 2**31 + 1]), (2, [5])], "id int, prints array<long>")
    got = {r.id: [(m["at"], m.word) for m in r.m] for r in rows.select("id", audio.pairs("prints", 2).alias("m")).collect()}
    upper = lambda x, y: x & audio.UPPER | (y & audio.UPPER) >> 1
    assert got == {1: [(0, upper(5, 5)), (1, upper(5, 7)), (3, upper(7, 2**31 + 1))], 2: []}


def test_landmarks_start_runs(spark):
    rows = spark.createDataFrame([(1, [5, 5, 5, 7, 7, 5])], "id int, prints array<long>")
    got = rows.select(audio.landmarks("prints").alias("m")).first().m
    assert [(m["at"], m.word) for m in got] == [(0, 5), (3, 7), (5, 5)]


def test_melodies_tell_vectors_apart():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 64))
    near = x + rng.normal(0, 0.02, 64)
    a, b, c = (audio.fingerprint(audio.chroma(audio.melody(v, 0))) for v in (x, near, y))
    error = lambda u, v: np.bitwise_count(u ^ v).sum() / 32 / len(u)
    assert error(a, b) < 0.12 and error(a, c) > 0.3
    assert len(audio.melody(None, 1)) == len(audio.melody([], 1)) == 0 and len(audio.melody([0.0, np.nan], None)) == 2 * audio.HOP


def test_many_queries_are_met_by_a_shuffle(spark, monkeypatch):
    made = {0: tune(1, 60), 50: tune(1, 60)[2000:], 3: tune(1, 60)[9000:], 4: tune(2, 60)}
    prints = audio.with_fingerprint(spark.createDataFrame([(i, wav(x)) for i, x in made.items()], "id long, audio binary"))
    want = sorted(audio.align(prints, F.col("id") % 50 == 0).collect())
    monkeypatch.setattr(audio, "MOST_INTEGERS", 10)
    assert sorted(audio.align(prints, F.col("id") % 50 == 0).collect()) == want and any(r.n_links for r in want)


def test_empty_table(spark):
    assert audio.align(audio.with_fingerprint(spark.createDataFrame([], SCHEMA)), F.col("id") % 50 == 0).count() == 0
