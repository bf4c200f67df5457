import random
import re

import numpy as np
import xxhash
from pyspark.sql import types as T

from tallyweave.llm import simhash
from tallyweave.llm.components import connected_components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fingerprint", T.StringType())])


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def variants(rng):
    base = ["word%d" % i for i in rng.integers(0, 900, 400)]
    texts = [None, "", "  \t\n", "one", "One TWO", "a b c", "A  b\tc", "ß É x", "x" * 1000, "solo nbsp word here"]
    for _ in range(60):
        own = list(base)
        for _ in range(int(rng.integers(0, 3))):
            own[int(rng.integers(0, 400))] = "other%d" % rng.integers(0, 50)
        texts.append(" ".join(own))
    return texts + [" ".join("w%d" % i for i in rng.integers(0, 5000, 50)) for _ in range(100)]


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    at = range(len(rows))
    pairs = [(i, j) for i in at for j in at if i < j and (prints[i] ^ prints[j]).bit_count() <= 3]
    parts = plain_components(pairs, at)
    first = {}
    for i in at:
        if rows[i][0] is not None:
            first[parts[i]] = min(first.get(parts[i], rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], prints[i] - (prints[i] >> 63 << 64), first.get(parts[i])) for i in at), key=str)


def test_matches_brute_force(spark):
    texts = variants(np.random.default_rng(3))
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(7, "a b c"), (7, "a b c"), (None, "lonely text of its own kind")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_large_buckets_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 4)
    texts = variants(np.random.default_rng(5))
    rows = list(enumerate(texts))
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_long_text_in_blocks():
    text = " ".join("w%d" % i for i in range(60_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (600, 600), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_components_with_hot_nodes(spark, monkeypatch):
    from tallyweave.llm import components

    monkeypatch.setattr(components, "FEW", 3)
    monkeypatch.setattr(components, "HOT", 20)
    rng = np.random.default_rng(2)
    edges = [(int(h), int(x)) for h in (50, 700) for x in rng.integers(0, 400, 150) + 500 * (h > 500)] + [(int(x), int(x) + 1) for x in rng.integers(1000, 1300, 200)]
    nodes = {n for e in edges for n in e}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_components(edges, nodes)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_rounds_of_small_graphs_are_few_stages(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 400)] + [(rng.randint(500, 900), rng.randint(500, 900)) for _ in range(200)]
    sc = spark.sparkContext
    sc.setJobGroup("small graph", "")
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    sc.setJobGroup("rest", "")
    tracker = sc.statusTracker()
    stages = {i for job in tracker.getJobIdsForGroup("small graph") for i in tracker.getJobInfo(job).stageIds}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = plain_components([e for e in edges if e[0] != e[1]], nodes)
    assert got == {n: want[n] for n in nodes}
    assert len(stages) <= 120  # 184 with joins


def test_components_of_large_graphs(spark, monkeypatch):
    from tallyweave.llm import components

    for most in (0, 700, 100_000):  # by joins, by windows, and first the one and then the other
        monkeypatch.setattr(components, "SMALL", most)
        monkeypatch.setattr(components, "FEW", 3)
        monkeypatch.setattr(components, "HOT", 20)
        rng = random.Random(most)
        edges = [(0, i) for i in range(1, 300)] + [(rng.randint(300, 700), rng.randint(300, 700)) for _ in range(150)] + [(5000 + i, i) for i in range(200)] + [(9000, 8000 + i) for i in range(200)]
        nodes = {x for e in edges if e[0] != e[1] for x in e}
        want = plain_components([e for e in edges if e[0] != e[1]], nodes)
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {n: want[n] for n in nodes}
