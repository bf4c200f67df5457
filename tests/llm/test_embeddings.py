import numpy as np
import pytest
from pyspark.sql import types as T

from tallyweave.llm import embeddings

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("n_links", T.StringType()),
])


def rows(seed):
    rng = np.random.default_rng(seed)
    made = []
    for label in (1, 2):
        centers = rng.normal(size=(12, 16))
        for i in range(150):
            made.append((centers[i % 12] + rng.normal(size=16) * (0.02 if i % 12 == 0 else 0.25), label))
    made = [(v.astype("f4").tolist(), label) for v, label in made]
    made += [made[0], made[0], (made[0][0], 2), (made[0][0], None)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [1e-30] * 8]
    made += [(v, 1) for v in odd]
    made = [(i, v, label) for i, (v, label) in enumerate(made)]
    return [(i, v, label, "clash") for i, v, label in made + [(None, made[3][1], 1), (5, made[5][1], made[5][2])]]


def expected(table, threshold):
    def fit(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [i for i, (_, v, label, _) in enumerate(table) if fit(v, label)]
    parent, links = list(range(len(table))), [0] * len(table)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in good:
        for j in good:
            x, y = (np.array(table[k][1], float) for k in (i, j))
            if i < j and table[i][2] == table[j][2] and len(x) == len(y):
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    names = {}
    for i, r in enumerate(table):
        if r[0] is not None:
            names[find(i)] = min(names.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], names.get(find(i), r[0])) for i, r in enumerate(table)), key=str)


@pytest.mark.parametrize("block", [2048, 16])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    table = rows(block)
    got = embeddings.near_vectors(spark.createDataFrame(table, SCHEMA), threshold=0.93).collect()
    assert sorted(map(tuple, got), key=str) == expected(table, 0.93)


def test_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for bits in (8, 12, 16):
        tables = embeddings.tables_for(0.93, bits, 0.999)
        met = (embeddings.signatures(x, tables, bits, 1) == embeddings.signatures(y, tables, bits, 1)).any(axis=1)
        assert met.mean() > 0.99


def test_empty_table(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_of_the_operator_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    table = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate((x, y)))]
    got = embeddings.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.component_id for r in got} <= set(range(800))  # no vector is linked with one that isn't its partner
    assert sum(r.n_links for r in got) >= 0.995 * 1600
