import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallyweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("offset", T.StringType())])


def fewest(items, capacity):
    """Exact bin packing of a few items by trying every placement."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= capacity}:
            j = bins.index(room)
            place(i + 1, bins[:j] + [room + items[i]] + bins[j + 1 :])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(30))
def test_fewest_bins_on_small_cases(seed):
    rng = np.random.default_rng(seed)
    items = rng.integers(1, 60, int(rng.integers(1, 11))).tolist()
    got = packing.bin_completion(np.bincount(items, minlength=101), 100)
    assert Counter(n for f in got for n in f.lengths * f.times) == Counter(items)
    assert all(sum(f.lengths) <= 100 for f in got)
    assert sum(f.times for f in got) == fewest(items, 100)


def test_large_case_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 2049, 20_000), minlength=2049)
    got = packing.bin_completion(counts)
    back = np.zeros(2049, int)
    for f in got:
        for n in f.lengths:
            back[n] += f.times
    assert (back == counts).all()
    assert sum(f.times for f in got) <= 1.005 * max(counts[1025:].sum(), (counts * np.arange(2049)).sum() / 2048)


def best_fit_bins(items, capacity):
    """Best-fit decreasing, one item at a time."""
    rooms = []
    for n in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return len(rooms)


@pytest.mark.parametrize("low,high,count", [(1, 100, 40), (25, 55, 300), (20, 50, 150), (1, 60, 200)])
def test_never_above_best_fit(low, high, count):
    for seed in range(50):
        rng = np.random.default_rng(seed)
        items = rng.integers(low, high + 1, int(rng.integers(1, count))).tolist()
        counts = np.bincount(items, minlength=101)
        plain = packing.best_fit(counts, 100)
        assert (sum(f.times * np.bincount(f.lengths, minlength=101) for f in plain) == counts).all()
        assert sum(f.times for f in plain) == best_fit_bins(items, 100)
        got = packing.bin_completion(counts, 100, nodes=100)
        assert (sum(f.times * np.bincount(f.lengths, minlength=101) for f in got) == counts).all()
        assert packing.bins_needed(counts, 100) <= sum(f.times for f in got) <= best_fit_bins(items, 100)


def test_bound_is_one():
    for seed in range(40):
        items = np.random.default_rng(seed).integers(1, 80, 8).tolist()
        assert packing.bins_needed(np.bincount(items, minlength=101), 100) <= fewest(items, 100)


def test_search_improves_on_best_fit():
    better = 0
    for seed in range(60):
        items = np.random.default_rng(seed).integers(15, 60, 24).tolist()
        counts = np.bincount(items, minlength=101)
        better += sum(f.times for f in packing.bin_completion(counts, 100)) < best_fit_bins(items, 100)
    assert better


def test_branches_are_tried_after_a_long_first_descent(monkeypatch):
    counts = np.bincount(np.random.default_rng(3).integers(1, 2049, 20_000), minlength=2049)
    counts[1:] += 1  # all 2048 lengths
    calls, plain = [], packing.completions
    monkeypatch.setattr(packing, "completions", lambda *a, **k: calls.append(1) or plain(*a, **k))
    packing.bin_completion(counts, nodes=0)
    descent = len(calls)
    calls.clear()
    got = packing.bin_completion(counts)
    assert len(calls) > descent > 0
    assert (sum(f.times * np.bincount(f.lengths, minlength=2049) for f in got) == counts).all()


#: The vocabulary's added tokens.
SPECIAL = [t.content for t in Tokenizer.from_file(PATH).get_added_tokens_decoder().values()]


def test_encoder_matches_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    encode = packing.encoder(PATH)
    odd = " ".join(f"a{chr(c)}b {chr(c)}{chr(c)} \n{chr(c)}" for c in [*range(1, 0x3100), *range(0x1F600, 0x1F650)])
    for text in ["", " ", "a  b", "It's  here\n\n x\t", "don't we'll I'd", "é" * 40, odd, odd.replace(" ", ""), *SPECIAL, " x ".join(SPECIAL), "".join(SPECIAL) * 2, "a  %s  b" % SPECIAL[0], "<|", "<|endoftext |>"]:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" ", "\n", " \n\t\u2003"])
def test_very_long_white_space(spark, run):
    want, long = Tokenizer.from_file(PATH), run * (2_000_000 // len(run))
    for text in (long, "a" + long + "b c", "word" + long, long + "word", "x  y" + long + "<|endoftext|> z"):
        assert packing.encoder(PATH)(text) == want.encode(text, add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, long, None), (2, "short", None)], SCHEMA)
    got = packing.pack_documents(rows, PATH).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == len(want.encode(long, add_special_tokens=False).ids) + 1


def test_pieces_and_places(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("w%d" % x for x in rng.integers(0, 500, int(rng.integers(1, 900)))), "clash") for i in range(60)]
    rows += [(100, None, None), (101, "", None), (None, "one two", None), (5, "same", None), (5, "same", None), (102, "long text " * 5000, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), PATH, capacity=512, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 512 or 512
        cuts = [0, *range(first, len(ids), 512), len(ids)] if len(ids) > 512 else [0, len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 512
    assert len(sequences) <= -(-sum(r.length for r in got) // 512) + 2


def test_a_common_length_is_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 4)
    rows = [(i, i // 7, 64 if i % 3 else 10, i % 5) for i in range(700)]
    got = packing.pack_pieces(spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long"), capacity=64).collect()
    assert Counter(r.length for r in got) == Counter(r[2] for r in rows)
    taken = Counter((r.sequence_id, x) for r in got for x in range(r.offset, r.offset + r.length))
    assert set(taken.values()) == {1} and len({r.sequence_id for r in got}) == 466 + 39


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
