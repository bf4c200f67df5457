import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyweave.llm import hmm_lm

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])


def toy(states=3, symbols=5, seed=0):
    rng = np.random.default_rng(seed)
    n = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm_lm.HiddenMarkovModel(n(rng.random(states)), n(rng.random((states, states))), n(rng.random((states, symbols))).T), rng


def plain(model, sequence):
    """Probability and expected counts by every path."""
    k = len(model.start)
    total, start, move, emit = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
    for path in itertools.product(range(k), repeat=len(sequence)):
        p = model.start[path[0]]
        for t, (s, x) in enumerate(zip(path, sequence)):
            p *= model.emit[x, s] * (model.move[path[t - 1], s] if t else 1)
        total += p
        start[path[0]] += p
        for t, (s, x) in enumerate(zip(path, sequence)):
            emit[x, s] += p
            if t:
                move[path[t - 1], s] += p
    return total, start / total, move / total, emit / total


@pytest.mark.parametrize("batch", [1_000_000, 6])
def test_forward_and_baum_welch_match_all_paths(monkeypatch, batch):
    monkeypatch.setattr(hmm_lm, "BATCH_TOKENS", batch)
    model, rng = toy()
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 6, 2, 6)]
    want = [plain(model, s) for s in sequences]
    assert np.allclose(model.log_likelihood(sequences), [math.log(w[0]) for w in want])
    for got, i in zip(model.counts(sequences), (1, 2, 3)):
        assert np.allclose(got, sum(w[i] for w in want))


def rows():
    rng = np.random.default_rng(1)
    texts = []
    for i in range(150):
        a = ["der", "die", "und", "haus"] if i % 2 else ["the", "and", "of", "house"]
        texts.append(" ".join(rng.choice(a + ["x%d" % rng.integers(0, 40)], int(rng.integers(1, 80)))))
    made = [(i, t, "clash") for i, t in enumerate(texts)]
    return made + [(900, None, None), (901, "", None), (None, "The THE unseen-word-%s" % ("y" * 60), None), (3, texts[3], None), (902, ("y" * 60 + " of ") * 3000, None)]


@pytest.mark.parametrize("few", [10_000, 2])
def test_scores(spark, monkeypatch, few):
    monkeypatch.setattr(hmm_lm, "FEW", few)
    monkeypatch.setattr(hmm_lm, "HOT", 100 if few == 2 else 5_000)
    monkeypatch.setattr(hmm_lm, "ENCODE_BYTES", 700 if few == 2 else 4_000_000)
    table = rows()
    got = hmm_lm.score_texts(spark.createDataFrame(table, SCHEMA), symbols=8, known=20, states=2).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    apart = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    seen = Counter(w for i, t, _ in table if not apart(i) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    want = sorted(((i, apart(i), len(tokens(t)), sum(w in seen for w in tokens(t)), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, _ in table), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_probabilities_of_short_texts_sum_below_one(spark):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(["a b", "b", "a a", "c"] * 10)], SCHEMA)
    probe = [" ".join(x) for k in range(4) for x in itertools.product("abcdefg", repeat=k)]
    both = docs.union(spark.createDataFrame([(i, t, None) for i, t in zip((i for i in range(1000, 10**6) if zlib.crc32(str(i).encode()) % 7 == 2), probe)], SCHEMA))
    got = hmm_lm.score_texts(both, symbols=3, known=3, states=2).filter("doc_id >= 1000").collect()
    assert 0.5 < sum(10**r.score for r in got) <= 1


def test_without_training_rows(spark):
    alone = spark.createDataFrame([(next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2), "a b", None)], SCHEMA)
    [r] = hmm_lm.score_texts(alone).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert hmm_lm.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0
