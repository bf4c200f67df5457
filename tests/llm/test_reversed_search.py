"""The reversed search against scoring every document for every item."""

import math
import re

import numpy as np
from pyspark.sql import types as T

from tallyweave.llm import reversed_search
from tallyweave.llm.reversed_search import rank_documents

DOCS = T.StructType([T.StructField(n, t) for n, t in [("doc_id", T.LongType()), ("text", T.StringType()), ("rank", T.StringType()), ("score", T.StringType())]])
ITEMS = T.StructType([T.StructField(n, t) for n, t in [("item_id", T.LongType()), ("text", T.StringType()), ("doc", T.StringType())]])
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, most=10):
    split = [(i, terms(t)) for i, t in docs if terms(t)]
    count, length = len(split), sum(len(t) for _, t in split)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    rows = []
    for item, words in wanted.items():
        found = []
        for doc, held in split:
            m, score = 10 + (90 * len(held) * count) // length, 0
            for word in words & set(held):
                df, tf = sum(word in t for _, t in split), held.count(word)
                score += math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        rows += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:most])]
    return rows


def check(spark, docs, items, **kwargs):
    found = rank_documents(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(5), spark.createDataFrame([(*i, "z") for i in items], ITEMS), **kwargs)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute_force(docs, items, kwargs.get("most", 10)), key=repr)


def table(seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "NAÏVE", "été", "x1", "ÀB"]
    pick = lambda n: " ".join(words[min(int(rng.exponential(12)), 64)] for _ in range(n))
    docs = [(i, pick(int(rng.integers(0, 60)))) for i in range(120)]
    docs += [(500 + i, docs[3][1]) for i in range(15)]  # ties by id
    docs += [(None, docs[3][1]), (None, docs[3][1]), (3, docs[3][1]), (600, None), (601, ""), (602, "... \n"), (603, "w1,W1;w1" * 20_000), (604, "É\x7fÉ\x80ü W2_w3")]
    items = [(i, pick(int(rng.integers(1, 20)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere at all"), (5, "w40 w41"), (None, "w7 ÀB"), (23, docs[3][1]), (24, "W1 " + "longword" * 50)]
    return docs, items


def test_equals_brute_force(spark):
    check(spark, *table())


def test_blocks_of_items_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(reversed_search, "MOST_BYTES", 300)
    monkeypatch.setattr(reversed_search, "BATCH_SCORES", 40)
    check(spark, *table(4), most=3)


def test_empty_tables(spark):
    docs, items = table()
    check(spark, [], items)
    check(spark, docs[:3], [])
    check(spark, [(1, None), (2, " ")], items)
