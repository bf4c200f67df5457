from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline

from .test_mixing import plain_targets
from .test_repeats import plain
from .test_simhash import plain_components, plain_fingerprint

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    words = {"en": ["the", "of", "river", "stone", "walks", "under", "seven"], "de": ["der", "und", "fluß", "stein", "geht", "unter", "sieben"]}
    # words of a document's own keep unrelated documents apart
    prose = lambda k, n, i: " ".join(f"{w}{i}x{j}" if j % 2 else str(w) for j, w in enumerate(rng.choice(words[k], n)))
    rows = [(i, prose(k := ("en", "de")[i % 2], int(rng.integers(3, 300)), i), k, f"s{i % 3}") for i in range(60)]
    passage = prose("en", 60, 999)
    rows += [(100 + i, prose("en", 40, 100 + i) + " " + passage + " " + prose("en", 30, 200 + i), "en", "s0") for i in range(6)]
    base = prose("de", 300, 300)
    rows += [(200 + i, base + f" end{i % 2}", "de", "s1") for i in range(4)]
    rows += [(300, None, "en", "s0"), (301, "", None, None), (302, "12 !!", "en", "s1"), (303, rows[0][1], "en", None), (0, rows[0][1], "en", "s0"), (None, "stone of the river", None, None)]
    rows = [(*r, len(r[1]) if r[1] else None) for r in rows]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    made, docs = [spark.read.parquet(f"{d}/documents.parquet")], None
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, made[-1], d)
        path = f"{d}/{len(made)}.parquet"
        docs.write.parquet(path)
        made.append(spark.read.parquet(path))
    return d, [[r.asDict() for r in x.collect()] for x in made], [x.columns for x in made]


def rows_of(table):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in table)


def test_columns_stay(stages):
    assert all(c == stages[2][0] for c in stages[2][:-1])


def test_language_stage(stages):
    before, after = stages[1][0], stages[1][1]
    want = [r for r in before if r["text"] and any(c.isalpha() for c in r["text"])]
    assert Counter((r["doc_id"], r["text"]) for r in want) == Counter((r["doc_id"], r["text"]) for r in after)
    assert all(r["lang"] in ("en", "de") for r in after)


def test_near_duplicate_stage(stages):
    before, after = stages[1][1], stages[1][2]
    prints = [plain_fingerprint(r["text"]) for r in before]
    at = range(len(before))
    part = plain_components([(i, j) for i in at for j in at if i < j and (prints[i] ^ prints[j]).bit_count() <= 3], at)
    first = {}
    for i in sorted(at, key=lambda i: (before[i]["doc_id"] is None, before[i]["doc_id"])):
        first.setdefault(part[i], before[i])
    assert rows_of(first.values()) == rows_of(after)
    assert len(after) < len(before)


def test_repeated_passage_stage(stages):
    before, after = stages[1][2], stages[1][3]
    want = []
    for r, runs in zip(before, plain([r["text"] for r in before], 200)):
        raw = r["text"].encode()
        ends = [0, *(x for run in runs for x in run), len(raw)]
        text = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])).decode(errors="ignore")
        if text.split():
            want.append(r | ({"text": text, "n_chars": len(text)} if runs else {}))
    assert rows_of(want) == rows_of(after)
    assert any(len(r["text"]) < len(b["text"]) for r in after for b in before if r["doc_id"] == b["doc_id"])


def test_mixing_stage(stages):
    before, after = rows_of(stages[1][3]), rows_of(stages[1][4])
    size = lambda row: len(row[1].split())
    sizes, taken = Counter(), Counter()
    for r, n in before.items():
        sizes[r[3]] += n * size(r)
    for r, n in after.items():
        assert n <= 3 * before[r]
        taken[r[3]] += n * size(r)
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= max(size(r) for r in before if r[3] == s) / 2 + 1e-6


def test_packing_stage(stages):
    docs, pieces = stages[1][4], stages[1][5]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) for r in docs)
    assert Counter((r["doc_id"], r["length"]) for r in pieces) == want  # none of them is long enough to be cut
    for s in {r["sequence_id"] for r in pieces}:
        end = 0
        for r in sorted((r for r in pieces if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 2048


def test_run_gives_the_same_rows(spark, stages):
    drop = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert Counter(drop(r.asDict()) for r in corpus_pipeline.run(spark, stages[0]).collect()) == Counter(map(drop, stages[1][5]))
