import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyweave.llm import langid

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])


def plain_phrases(text, train):
    """Greedy longest matches by substring search in the symbols of the labelled texts."""
    count = i = 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in train:
            n += 1
        i += max(1, n - 1)
        count += 1
    return count


@pytest.mark.parametrize("seed", range(6))
def test_phrases_match_substring_search(seed):
    rng = np.random.default_rng(seed)
    make = lambda letters, n: "".join(rng.choice(list(letters), n))
    samples = {"x": [make("abc ", 300), make("abc", 50)], "y": [make("bcd ", 400)], "z": ["a" * 700]}
    parser = langid.train(samples)
    texts = [make("abcd ", n) for n in (1, 2, 17, 1023, 1024, 1025, 5000)] + ["zzz", "aaaa zé", "b", "a" * 3000, samples["x"][0] * 9, "b" * 1011 + "a" * 700 + "b" * 900]
    symbols = [parser.symbols(t) for t in texts]
    got = parser.phrases(symbols)
    for k, name in enumerate(parser.languages):
        train = np.concatenate([np.append(parser.symbols(t), np.uint8(0)) for t in samples[name]])
        assert got[:, k].tolist() == [plain_phrases(s.tobytes(), train.tobytes()) for s in symbols]


def test_languages_with_thousands_of_letters():
    rng = np.random.default_rng(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    common = 1 / np.arange(1, 3001)
    orders = {"one": common, "two": common[::-1], "three": np.roll(common, 1500)}
    make = lambda p, n: "".join(rng.choice(letters, n, p=p / p.sum()))
    latin = {f"l{i}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 3000, p=rng.dirichlet(np.ones(27))))] for i in range(5)}
    parser = langid.train({k: [make(p, 200) for _ in range(30)] for k, p in orders.items()} | latin)
    codes = {parser.symbols(c).tobytes() for c in letters + list("abcdefghijklmnopqrstuvwxyz")}
    assert len({x for x in codes if x != bytes([langid.OTHER])}) >= 2500  # every letter that a sample has is told apart
    for name, p in orders.items():
        assert parser.predict([make(p, 120) for _ in range(40)])[0] == [name] * 40
    long = parser.symbols(make(common, 4000))
    sample = parser.phrases([long, long[:1000]])
    assert (sample[0] > sample[1]).all()


def test_letters_of_all_planes():
    parser = langid.train({"x": ["abc abc"], "y": ["\U00020000\U00020001 \U00030000"]})
    assert parser.predict(["\U000e0041\U000e0042", "\U000f0001", "\u0301", "1", "\U00030000"])[0] == ["und"] * 4 + ["y"]
    assert "und" not in parser.predict(["\U00030001", "\U0001d400"])[0]  # letters that no label has


def test_sample_has_whole_texts(spark, monkeypatch):
    rows = [(i, f"text {'abcdefgh'[i]} " * 3, "aa") for i in range(8)] + [(20, "long " * 30, "aa"), (21, "only a long text " * 9, "bb"), (22, "only a longer text " * 9, "bb"), (23, None, "cc"), (24, "12", "cc")]
    taken = {}
    monkeypatch.setattr(langid, "train", lambda samples: taken.update(samples))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=5, max_chars=60)
    texts = {r[1] for r in rows}
    assert {k: len(v) for k, v in taken.items()} == {"aa": 5, "bb": 1}
    assert all(t in texts and not t.startswith("long") for v in taken.values() for t in v)
    assert taken["bb"] == ["only a long text " * 9]


def test_edge_cases(spark):
    words = {"aa": "the of and with from this that", "bb": "der die und mit von ist nicht"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[k].split(), 40)), k, "x") for i in range(60) for k in words]
    rows += [(900, None, "aa", None), (901, "", "bb", None), (902, "123 !?", "aa", None), (None, "the of and the of with", None, None), (903, "THE OF AND " * 20_000, None, None)]
    got = langid.fit_and_identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        if not r.text or r.text.startswith("1"):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == (r.lang or "aa")


def test_without_labels_or_rows(spark):
    assert [r.lang_pred for r in langid.fit_and_identify(spark.createDataFrame([(1, "abc", None, None)], SCHEMA)).collect()] == ["und"]
    assert langid.fit_and_identify(spark.createDataFrame([], SCHEMA)).count() == 0
