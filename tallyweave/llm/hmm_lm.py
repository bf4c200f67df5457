"""Hidden Markov language model over words, trained by Baum-Welch on all partitions.

The commonest words are symbols of their own; any other word is emitted as a
class (by its last byte) and, within the class, with add-one probability.  So
every text has a proper probability, and the model's part and the words' parts
multiply exactly.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, cut, id_crc, release_memory, slices, token_blocks

#: What ends a text, as a token; no word holds a space.
END = b" "
CLASSES = 32
#: Text counted in one go, text encoded in one go, tokens of one batch of sequences, and the longest sequence in training.
COUNT_BYTES = 16_000_000
ENCODE_BYTES = 4_000_000
BATCH_TOKENS = 300_000
SEGMENT = 512
LONG_WORD = 40


def word_key(word: bytes) -> bytes:
    """A word as a join key: itself, or a 128-bit digest that keeps its last byte if it is long."""
    return word if len(word) <= LONG_WORD else b" " + hashlib.blake2b(word, digest_size=16).digest() + word[-1:]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c): how often each token occurs, ends included; counted per block of text before the shuffle."""

    def count(batches):
        from collections import Counter

        seen, size = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                raw = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(LOWER_BYTES)
                for tokens in token_blocks(raw):
                    seen.update(tokens)
                seen[END] += 1
                size += len(raw)
                if size >= COUNT_BYTES:
                    yield table(seen)
                    seen, size = Counter(), 0
            release_memory()
        if seen:
            yield table(seen)

    def table(seen):
        return pa.RecordBatch.from_arrays([pa.array(map(word_key, seen), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

    return docs.select(F.col(text_col).cast("binary")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The known words with their counts, commonest first; the first ``symbols`` are model symbols."""

    words: list[bytes]
    counts: np.ndarray
    symbols: int
    tokens: int
    distinct: int
    class_size: np.ndarray  # tokens plus words of each class, plus one for a word never seen
    least_band: int  # of the known words' counts

    @property
    def width(self) -> int:
        return self.symbols + CLASSES


def count_band() -> Column:
    """Counts in bands of an eighth of an octave."""
    return F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")


def vocabulary(words: DataFrame, *, symbols: int, known: int) -> Vocabulary:
    """The commonest words, at most ``known``, and the totals of the rest.

    A histogram of counts, some hundred rows, tells from which count on words
    are few enough; no words are sorted.
    """
    bands = {r.b: r.v for r in words.groupBy(count_band().alias("b")).agg(F.count("*").alias("v")).collect()}
    least, room = max(bands, default=0) + 1, known
    while least - 1 >= min(bands, default=0) and bands.get(least - 1, 0) <= room:
        least -= 1
        room -= bands.get(least, 0)
    top = words.filter(count_band() >= least).toArrow()
    found, counts = top.column("word").to_pylist(), np.asarray(top.column("c"), dtype=np.int64)
    order = sorted(range(len(found)), key=lambda i: (-int(counts[i]), found[i]))
    found, counts = [found[i] for i in order], counts[order]
    kind = F.conv(F.hex(F.expr("substring(word, length(word), 1)")), 16, 10).cast("int") % CLASSES
    totals = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    size = np.ones(CLASSES, np.int64)
    for r in words.groupBy(kind.alias("k")).agg((F.sum("c") + F.count("*")).alias("s")).collect():
        size[r.k] += r.s
    symbols = min(symbols, len(found))
    for w, c in zip(found[:symbols], counts[:symbols], strict=True):
        size[w[-1] % CLASSES] -= c + 1
    return Vocabulary(found, counts, symbols, totals.n or 0, totals.v, size, least)


def encode(docs: DataFrame, vocab: Vocabulary, *, id_col: str, text_col: str) -> DataFrame:
    """Per row: codes (model symbols), sums over the known words, and the other words as they stand."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # at most ``known`` words

    def run(batches):
        v = shared.value
        index = {w: i for i, w in enumerate(v.words)}
        log_count = np.append(np.log10(v.counts + 1.0), 0.0)
        kind = np.array([w[-1] % CLASSES for w in v.words] + [0], np.int64)
        code_of = np.arange(len(v.words) + 1)
        code_of[v.symbols :] = v.symbols + kind[v.symbols :]
        log_class = np.log10(v.class_size)
        for batch in batches:
            rows, first, size = [], 0, 0
            for text in batch.column(1):
                raw = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(LOWER_BYTES)
                codes, other, logs, inner, known = [], [], 0.0, 0.0, 0
                for tokens in [*token_blocks(raw), [END]]:
                    at = np.fromiter(map(index.get, tokens, repeat(-1)), np.int64, len(tokens))
                    missing = np.flatnonzero(at < 0)
                    for i in missing.tolist():  # long words are known by their digest
                        if len(tokens[i]) > LONG_WORD:
                            at[i] = index.get(word_key(tokens[i]), -1)
                    missing = np.flatnonzero(at < 0)
                    code = code_of[at]
                    strange = [tokens[i] for i in missing.tolist()]
                    code[missing] = v.symbols + np.fromiter((w[-1] % CLASSES for w in strange), np.int64, len(strange))
                    other += map(word_key, strange)
                    classed = code >= v.symbols
                    logs += log_count[at].sum()
                    inner += log_count[at[classed]].sum() - log_class[code[classed] - v.symbols].sum()
                    known += len(at) - len(missing)
                    codes.append(code.astype("<u2"))
                codes = np.concatenate(codes)
                rows.append((len(codes), codes.tobytes(), float(logs), float(inner), known, other))
                size += len(raw)
                if size >= ENCODE_BYTES:  # what is held doesn't depend on the batch
                    yield pack(batch.column(0).slice(first, len(rows)), rows)
                    rows, first, size = [], first + len(rows), 0
            if rows:
                yield pack(batch.column(0).slice(first, len(rows)), rows)
            del rows
            release_memory()

    def pack(ids, rows):
        types = (pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", "n_tokens", "codes", "logs", "inner", "known", "other"])

    schema = f"doc_id {id_type}, n_tokens long, codes binary, logs double, inner double, known long, other array<binary>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


@dataclass
class HiddenMarkovModel:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    @classmethod
    def initial(cls, unigram: np.ndarray, states: int, seed: int) -> HiddenMarkovModel:
        """Sticky states around the unigram distribution, told apart by noise."""
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * rng.uniform(0.5, 1.5, (len(unigram), states))
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def log_likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihoods by the scaled forward recursion, all sequences in step."""
        out = np.zeros(len(sequences))
        for part, steps, live in in_step(sequences):
            total = np.zeros(len(part))
            for t, n in enumerate(live):
                a = (self.start if t == 0 else a[:n] @ self.move) * self.emit[steps[t]]
                scale = a.sum(axis=1)
                a /= scale[:, None]
                total[:n] += np.log(scale)
            out[part] = total
        return out

    def counts(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions (one Baum-Welch E-step)."""
        start, move, emit = np.zeros_like(self.start), np.zeros_like(self.move), np.zeros_like(self.emit)
        for _, steps, live in in_step(sequences):
            ahead, scales = [], []
            for t, n in enumerate(live):
                a = (self.start if t == 0 else ahead[-1][:n] @ self.move) * self.emit[steps[t]]
                scales.append(a.sum(axis=1, keepdims=True))
                ahead.append(a / scales[-1])
            after = np.zeros((0, len(start)))
            for t in range(len(live) - 1, -1, -1):
                back = np.ones((live[t], len(start)))
                if len(after):
                    weighted = self.emit[steps[t + 1]] * after / scales[t + 1]
                    move += ahead[t][: len(after)].T @ weighted
                    back[: len(after)] = weighted @ self.move.T
                ahead[t] *= back
                if t == 0:
                    start += ahead[0].sum(axis=0)
                after = back
            states, symbols = np.concatenate(ahead), np.concatenate(steps)
            for s in range(len(start)):
                emit[:, s] += np.bincount(symbols, weights=states[:, s], minlength=len(emit))
        return start, move * self.move, emit

    def updated(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> HiddenMarkovModel:
        """M-step; one pseudo-count each is spread evenly, and over symbols as the unigram."""
        k = len(start)
        return HiddenMarkovModel(
            (start + 1 / k) / (start.sum() + 1),
            (move + 1 / k) / (move.sum(axis=1, keepdims=True) + 1),
            (emit + unigram[:, None]) / (emit.sum(axis=0) + 1),
        )


def in_step(sequences: list[np.ndarray]):
    """Batches of sequences, longest first: (positions, symbols at each step, sequences at each step)."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    for a, b in slices([len(sequences[i]) for i in order], BATCH_TOKENS):
        part = order[a:b]
        sizes = np.array([len(sequences[i]) for i in part])
        flat = np.concatenate([sequences[i] for i in part]).astype(np.int64)
        # by step, then by sequence: within a step the sequences that are still going come first
        step = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = flat[np.argsort(step, kind="stable")]
        live = np.bincount(step)
        yield part, np.split(flat, np.cumsum(live)[:-1]), live.tolist()


def sequences_of(batch) -> list[np.ndarray]:
    return [np.frombuffer(c.as_buffer(), "<u2") for c in batch]


def expected_counts(encoded: DataFrame, model: HiddenMarkovModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One E-step over all rows: counts per task, summed over tasks by Spark.

    Texts are trained on in segments of at most ``SEGMENT`` tokens.  The driver
    receives one row per symbol and state, whatever the corpus.
    """
    states, symbols = len(model.start), len(model.emit)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total = None
        for batch in batches:
            parts = [s[i : i + SEGMENT] for s in sequences_of(batch.column(0)) for i in range(0, len(s), SEGMENT)]
            if parts:
                start, move, emit = shared.value.counts(parts)
                now = np.concatenate((start[None], move, emit))
                total = now if total is None else total + now
            release_memory()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *(pa.array(total[:, s].copy()) for s in range(states))], ["row", *(f"s{s}" for s in range(states))])

    schema = ", ".join(["row long", *(f"s{s} double" for s in range(states))])
    summed = encoded.select("codes").mapInArrow(run, schema).groupBy("row").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)])
    out = np.zeros((1 + states + symbols, states))
    for r in summed.collect():
        out[r["row"]] = r[1:]
    return out[0], out[1 : 1 + states], out[1 + states :]


def train(encoded: DataFrame, unigram: np.ndarray, *, states: int, parts: int, passes: int, seed: int) -> HiddenMarkovModel:
    """Baum-Welch: first an update from each of ``parts`` parts of the rows, then ``passes`` over all rows."""
    model = HiddenMarkovModel.initial(unigram, states, seed)
    part = F.pmod(F.xxhash64("rid"), F.lit(parts))
    for rows in [*(encoded.filter(part == i) for i in range(parts)), *[encoded] * passes]:
        model = model.updated(*expected_counts(rows, model), unigram)
    return model


#: A word with more than this share of all looked-up words meets its count by broadcast.
HOT = 5_000
#: Occurrences of one word that a task looks up in any case.
FEW = 10_000


def with_counts(rare: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(rid, word, c) of the words that ``counts`` (word, c) has, of ``total`` words in ``rare``.

    Words that occur very often, known or not, are fewer than ``HOT`` by their
    number; these meet their counts by broadcast, so none gathers in a task.
    """
    limit = max(FEW, -(-total // HOT))
    often = rare.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("word")
    hot = often.join(counts.select("word", "c"), "word", "left").withColumn("hot", F.lit(True))
    met = rare.join(F.broadcast(hot), "word", "left")
    rest = met.filter("hot IS NULL").select("rid", "word").join(counts.select("word", "c"), "word")
    return met.filter("hot AND c IS NOT NULL").select("rid", "word", "c").unionByName(rest)


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, symbols: int = 4096, known: int = 200_000, states: int = 8, parts: int = 4, passes: int = 1, seed: int = 3) -> DataFrame:
    """Log10 probability of each whole text under a word HMM and under its unigram base.

    Learns from all rows whose id's CRC-32 mod ``folds`` isn't ``held_out``.
    Returns per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts cover every training token.  The commonest ``known`` words (a fixed
    bound) are looked up in the tasks; the others are joined with the count
    table, so no vocabulary is held whole anywhere.  Training restarts at every
    ``SEGMENT``-th token of a text, so the start probabilities are also learned
    within texts; scores run through whole texts, however long.  Null and empty texts are
    the end token alone; repeated rows count each and score alike; with no
    training row nothing is known and the base is 0; an empty table gives an
    empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    apart = id_crc(F.col("doc_id")) % folds == held_out
    words = cut(word_counts(rows.filter(~apart)), "lm-words")
    vocab = vocabulary(words, symbols=symbols, known=known)
    encoded = encode(rows, vocab, id_col="doc_id", text_col="text")
    encoded = cut(encoded.withColumn("rid", F.monotonically_increasing_id()).withColumn("held_out", apart), "lm-encoded")
    weights = np.concatenate((vocab.counts[: vocab.symbols] + 1.0, vocab.class_size.astype(float)))
    unigram = weights / weights.sum()
    model = train(encoded.filter(~F.col("held_out")), unigram, states=states, parts=parts, passes=passes, seed=seed)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()
    kept = ["rid", "doc_id", "held_out", "n_tokens", "logs", "inner", "known"]

    def forward(batches):
        for batch in batches:
            if batch.num_rows:
                found = shared.value.log_likelihood(sequences_of(batch.column(0))) / math.log(10)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found)], [*kept, "model"])

    scored = encoded.select("codes", *kept).mapInArrow(forward, f"rid long, doc_id {id_type}, held_out boolean, n_tokens long, logs double, inner double, known long, model double")
    rare = encoded.select("rid", F.explode("other").alias("word"))
    met = with_counts(rare, words.filter(count_band() < vocab.least_band), encoded.agg(F.sum(F.size("other"))).first()[0] or 0)
    sums = met.groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("found"))
    whole = math.log10(vocab.tokens + vocab.distinct + 1)
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(sums, "rid", "left").select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model") + F.col("inner") + more).alias("score"),
    )
