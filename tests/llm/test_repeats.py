from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyweave.llm import repeats

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType())])


def plain(texts, width):
    """Removed runs of each text, by counting every string."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        out.append([(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])])
    return out


def texts(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcdeé \n"), n))
    shared = [word(n) for n in (150, 199, 200, 201, 260, 700, 1500)]
    made = [None, "", "short", word(199), word(200), "x" * 900, "xy" * 400 + "x" * 300, "line of a list that repeats\n" * 30, word(4000)]
    for _ in range(25):
        made.append("".join(p for _ in range(int(rng.integers(1, 4))) for p in (word(int(rng.integers(0, 300))), shared[int(rng.integers(0, 7))])))
    base = word(1200)
    for _ in range(12):  # near copies
        i = int(rng.integers(0, 1100))
        made.append(base[:i] + word(3) + base[i + int(rng.integers(0, 60)) :])
    part = word(400)
    made += [word(100) + part[a : a + 280] + word(100) for a in rng.integers(0, 120, 20).tolist()]
    return made + [made[-1], made[-2], made[-2]]


def check(spark, made, ids=None):
    ids = ids or list(range(len(made)))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, made)], SCHEMA).repartition(3)
    got = repeats.remove_repeats(docs, width=200).collect()
    want = []
    for i, t, runs in zip(ids, made, plain(made, 200)):
        raw = (t or "").encode()
        gone = {k for a, b in runs for k in range(a, b)}
        want.append((i, len(raw), tuple(runs), bytes(c for k, c in enumerate(raw) if k not in gone)))
    assert sorted([(r.doc_id, r.n_bytes, tuple((x.start, x.end) for x in r.removed), bytes(r.kept)) for r in got], key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_matches_counting_every_string(spark, seed):
    check(spark, texts(seed))


@pytest.mark.parametrize("rows,split", [(1, 6), (2, 3), (5, 50)])
def test_crowded_grams_and_small_steps(spark, monkeypatch, rows, split):
    monkeypatch.setattr(repeats, "CLASS_ROWS", rows)
    monkeypatch.setattr(repeats, "SPLIT", split)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    made = texts(7)
    check(spark, made, [None if i % 9 == 0 else i // 2 for i in range(len(made))])


def test_crowded_grams_that_recur_in_a_string(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CLASS_ROWS", 2)
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    # a run of one character, and a short line four times, whose grams are anchors as their hashes are low
    hashed = lambda t: int(repeats.gram_hashes(np.frombuffer(t.encode(), np.uint8)).min())
    middles = [min((chr(c) * 80 for c in range(33, 127)), key=hashed), min((f"- item {i:03}: a line\n" * 4 for i in range(1000)), key=hashed)]
    for middle in middles:
        around = [word(300) + middle + word(300) for _ in range(12)]
        assert not any(plain(around, 200))
        docs = spark.createDataFrame(list(enumerate(around)), "doc_id long, text string")
        got = repeats.remove_repeats(docs).select("removed").collect()
        assert [r.removed for r in got] == [[]] * len(around)
        check(spark, [*around, *texts(8)[:40]])


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_interval_tree_matches_all_pairs(seed):
    rng = np.random.default_rng(seed)
    text = lambda n: bytes(rng.choice(list(b"ab"), n, p=[0.93, 0.07]))
    members = [(text(int(rng.integers(2, 12))), text(int(rng.integers(8, 16))), int(rng.integers(1, 3))) for _ in range(int(rng.integers(1, 12)))]
    want = [set() for _ in members]
    for i, x in enumerate(members):
        for j, y in enumerate(members):
            left, right = (repeats.common_prefix(x[k], y[k]) for k in (0, 1))
            if (i != j or x[2] > 1) and left + right >= 14:
                want[i] |= set(range(-left, right))
    got = [set() for _ in members]
    for i, left, right in repeats.maximal_repeats(members, 14):
        got[i] |= set(range(-left, right))
    assert got == want


def test_anchors_of_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 103, 9000).astype(np.uint8)
    at = np.array([0, 10, 10, 260, 7000, 9000])
    whole = repeats.text_anchors(raw, at, 200)
    monkeypatch.setattr(repeats, "CHUNK", 500)
    for x, y in zip(whole, repeats.text_anchors(raw, at, 200)):
        assert (x == y).all()
    owner, places, _ = whole
    for d in (2, 3, 4):  # every string of 200 bytes has an anchor that lies in it whole
        mine = places[owner == d]
        for s in range(at[d], at[d + 1] - 199):
            assert ((mine >= s) & (mine + repeats.GRAM <= s + 200)).any()
    assert set(owner) == {2, 3, 4}
