import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from tallyweave.llm import quality

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType())])


def sparse(texts):
    raw, at = quality.byte_column(pa.array(texts, pa.string()))
    return quality.features(raw, at)


def test_sum_of_squares_identity_matches_all_pairs():
    rng = np.random.default_rng(1)
    model = quality.FactorisationMachine(0.3, rng.normal(0, 1, quality.FEATURES).astype("f4"), rng.normal(0, 0.5, (quality.FEATURES, 3)).astype("f4"))
    texts = ["The cat sat.\nThe cat sat.", "", "ÀB 12 $$$ x x x", "a"]
    row, column, value = sparse(texts)
    got = model.scores(row, column, value, len(texts))
    for i in range(len(texts)):
        c, x = column[row == i], value[row == i].astype(float)
        logit = model.bias + (model.linear[c] * x).sum()
        for a in range(len(c)):
            for b in range(a + 1, len(c)):
                logit += float(model.factors[c[a]] @ model.factors[c[b]]) * x[a] * x[b]
        assert abs(got[i] - 1 / (1 + np.exp(-logit))) < 1e-5


def test_features_don_t_depend_on_the_batch():
    texts = ["Hello world\nagain", None, "", "\n\n", " x ", "Hello world\nagain", "é" * 50, "a\na\nb", "trailing\n"]
    row, column, value = sparse(texts)
    for i, t in enumerate(texts):
        r, c, v = sparse([t])
        assert (column[row == i] == c).all() and np.allclose(value[row == i], v)
    own = column[row == 0]
    assert len(own) == 3 + len(quality.STATISTICS)


def test_held_out_accuracy_and_edge_cases(spark):
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"], 60)) + "." for _ in range(250)]
    bad = [" ".join(rng.choice(["alpha!!", "BETA###", "gamma", "$$$"], 60)) for _ in range(250)]
    rows = [(i, t, "x") for i, t in enumerate(t for pair in zip(good, bad) for t in pair)]
    labels = [(i, 1 - i % 2) for i, *_ in rows] + [(None, 1), (3, None), (10_000, 0)]
    rows += [(2000, None, None), (2001, "", None), (None, good[0], None), (2002, "word " * 200_000, None), (0, good[0], None)]
    got = quality.fit_and_score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), updates=100).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.text == good[0]}) == 1


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert quality.fit_and_score(spark.createDataFrame([(1, "a", None)], DOCS), none).count() == 1
    assert quality.fit_and_score(spark.createDataFrame([], DOCS), none).count() == 0
