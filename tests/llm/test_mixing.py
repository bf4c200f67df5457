import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyweave.llm import mixing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("mix", T.StringType())])


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight, stop at the caps, share what is above again, until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def check(spark, rows):
    got = [(r.doc_id, r.source, *r.mix) for r in mixing.mix_sources(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = plain_targets(sizes)
    key = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}\x1f{t or ''}".encode()).hexdigest()[:15], 16)
    want = []
    for s in sizes:
        base = int(targets[s] / sizes[s]) if sizes[s] else 0
        budget, below = targets[s] - base * sizes[s], 0
        for _, i, n in sorted(((key(i, t), i, size(t)) for i, t, x in rows if x == s and size(t)), key=lambda r: r[0]):
            copies = base + (below + n / 2 <= budget)  # a row is taken once more if half of it fits
            below += n
            want.append((i, s, n, sizes[s], round(float(targets[s]), 6), copies, n * copies))
        want += [(i, s, 0, sizes[s], round(float(targets[s]), 6), None, 0) for i, t, x in rows if x == s and not size(t)]
    got = [(*r[:4], round(r[4], 6), r[5] if r[2] else None, r[6]) for r in got]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for s in sizes:
        biggest = max(size(t) for _, t, x in rows if x == s)
        assert abs(sum(r[6] for r in got if r[1] == s) - targets[s]) <= biggest / 2 + 1e-6
        assert all(r[6] <= 3 * r[2] for r in got)


@pytest.mark.parametrize("doc_id", [7, None])
def test_repeated_and_null_ids(spark, doc_id):
    # equal documents of three sources, and texts that differ under one id
    check(spark, [(doc_id, "ten words " * 5, s) for s in "abc" for _ in range(50)])
    check(spark, [(doc_id, "word " * (n % 9 + 1) + str(n % 20), s) for s in ("a", "b", None) for n in range(60)])


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), rng.choice(["a", "b", "b", "b", "Z", "é", "hot", "hot", "hot", "tiny"], 1)[0].item()) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "x " * 30_000, "Z"), (None, "no id", "a"), (None, "no id", "a"), (7, "again and again", "hot"), (7, "again and again", "hot"), (1003, "null source", None), (1004, "\t\n", "blank")]
    check(spark, rows)


def test_single_source_and_empty(spark):
    check(spark, [(1, "a b c", "x"), (2, "d", "x")])
    check(spark, [(1, None, None)])
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_sources_are_met_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), rng.choice(["a", "b", "hot", "hot", "hot"]).item()) for i in range(120)]
    check(spark, rows + [(500, "null source", None), (501, None, "a")])
