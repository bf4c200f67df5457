"""Quality classifier: a factorisation machine over hashed words and structure.

A text is a sparse vector: hashed words with L2-normalised log counts, and
binned structure statistics and metadata with value 1.  The model scores

    w0 + sum_i w_i x_i + 1/2 sum_k [(sum_i v_ik x_i)^2 - sum_i v_ik^2 x_i^2]

whose second part is every pairwise interaction at the cost of one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import byte_column, id_crc, slices

WORD_BITS = 14
BINS = 16
#: Structure statistics, each cut into ``BINS`` bins.
STATISTICS = ("length", "words", "mean_word", "upper", "digits", "symbols", "lines", "repeated_lines", "repeated_words", "breaks", "non_ascii", "sentence_ends")
#: Hashed values of metadata columns.
META = 1 << 12
FEATURES = (1 << WORD_BITS) + BINS * len(STATISTICS) + META
#: Bytes of text in one vectorised step.
CHUNK = 1_500_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.zeros(256, np.uint8)  # 1 upper case, 2 digit, 3 symbol, 4 beyond ASCII
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_KIND[128:] = 4
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x100000001B3  # odd, so it has an inverse modulo 2^64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run values[start:end], from prefix sums modulo 2^64."""
    powers = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        power = np.full(len(values) + 1, base, np.uint64)
        power[0] = 1
        powers.append(np.multiply.accumulate(power))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(values + np.uint64(1)) * powers[0][:-1], dtype=np.uint64)))
    # the sum of a run carries base^start; the inverse takes it out
    return _mix((total[ends] - total[starts]) * powers[1][starts])


def _ratio_bins(part, whole) -> np.ndarray:
    """Bins of a share, finer near 0: bin 0 is none at all."""
    share = part / np.maximum(whole, 1)
    return np.where(share <= 0, 0, np.clip(BINS - 1 + np.floor(np.log2(np.maximum(share, 1e-9)) * 1.5), 1, BINS - 1)).astype(np.int64)


def _size_bins(n) -> np.ndarray:
    return np.minimum(np.log2(np.asarray(n) + 1.0), BINS - 1).astype(np.int64)


def features(raw: np.ndarray, at: np.ndarray, meta: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of the texts raw[at[i]:at[i+1]]: (row, feature, value), by row; ``meta`` has hashed metadata (texts x columns)."""
    docs = len(at) - 1
    padded = np.concatenate((raw, np.array([10], np.uint8)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    space = _SPACE[padded]
    space[-1] = True
    inside = ~space
    begin = inside & (edge | np.concatenate(([True], space[:-1])))
    starts = np.flatnonzero(begin)
    last = inside & np.concatenate((edge[1:] | space[1:], [True]))
    ends = np.flatnonzero(last) + 1
    word_doc = np.searchsorted(at, starts, side="right") - 1
    size = np.diff(at)
    words = np.bincount(word_doc, minlength=docs)
    hashes = _run_hash(_LOWER[raw], starts, ends)
    kind = _KIND[raw]
    sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[at])
    # repeated lines: equal hashes within a document, empty lines apart
    breaks = np.flatnonzero(raw == 10)
    line_starts = np.unique(np.concatenate((at[:-1][size > 0], breaks + 1)))
    line_starts = line_starts[line_starts < len(raw)]
    line_ends = np.minimum(np.concatenate((line_starts[1:], [len(raw)])), at[np.searchsorted(at, line_starts, side="right")])
    line_ends = np.where((line_ends > line_starts) & (raw[np.maximum(line_ends - 1, 0)] == 10), line_ends - 1, line_ends)
    filled = line_ends > line_starts
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_doc = np.searchsorted(at, line_starts, side="right") - 1
    lines = np.bincount(line_doc, minlength=docs)
    line_key = _mix(_run_hash(_LOWER[raw], line_starts, line_ends) + line_doc.astype(np.uint64))
    distinct_lines = np.bincount(line_doc[np.unique(line_key, return_index=True)[1]], minlength=docs)
    # hashed words, counted by document
    key, count = np.unique((word_doc.astype(np.int64) << WORD_BITS) | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    row, column = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=docs))
    value = value / norm[row]
    distinct_words = np.bincount(row, minlength=docs)
    stops = sums(np.isin(raw, np.frombuffer(b".!?", np.uint8)))
    bins = np.stack([
        _size_bins(size), _size_bins(words), np.minimum(size / np.maximum(words, 1), BINS - 1).astype(np.int64),
        _ratio_bins(sums(kind == 1), size), _ratio_bins(sums(kind == 2), size), _ratio_bins(sums(kind == 3), size), _size_bins(lines),
        _ratio_bins(lines - distinct_lines, lines), _ratio_bins(words - distinct_words, words), _ratio_bins(lines, words), _ratio_bins(sums(kind == 4), size), _ratio_bins(stops, words),
    ], axis=1) + (1 << WORD_BITS) + BINS * np.arange(len(STATISTICS))
    row = np.concatenate((row, np.repeat(np.arange(docs), len(STATISTICS))))
    column = np.concatenate((column, bins.reshape(-1)))
    value = np.concatenate((value, np.ones(bins.size)))
    if meta is not None and meta.size:
        row = np.concatenate((row, np.repeat(np.arange(docs), meta.shape[1])))
        column = np.concatenate((column, (meta + (FEATURES - META)).reshape(-1)))
        value = np.concatenate((value, np.ones(meta.size)))
    order = np.argsort(row, kind="stable")
    return row[order], column[order], value[order].astype(np.float32)


@dataclass
class FactorisationMachine:
    """Weights of one model: bias, linear weights, factors (features x rank)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Probability of label 1 for each row of a sparse matrix sorted by row."""
        terms = np.empty((len(row), 2 + self.factors.shape[1]), np.float32)
        vx = self.factors[column] * value[:, None]
        terms[:, 0] = self.linear[column] * value
        terms[:, 1] = (vx**2).sum(axis=1)
        terms[:, 2:] = vx
        first = np.searchsorted(row, np.arange(rows))
        total = np.add.reduceat(terms, first, axis=0, dtype=np.float64)  # every row has its statistics
        logit = self.bias + total[:, 0] + 0.5 * ((total[:, 2:] ** 2).sum(axis=1) - total[:, 1])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, rank: int = 4, updates: int = 600, rate: float = 0.15, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss, in ``updates`` mini-batches or some more.

    Both labels weigh alike as a whole, so that the rarer one isn't outvoted.
    """
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 0.01, 0.99) if len(labels) else 0.5
    weight = np.where(labels > 0.5, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    model = FactorisationMachine(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, rank)).astype(np.float32))
    seen_w, seen_v = np.full(FEATURES, 1e-3, np.float32), np.full((FEATURES, rank), 1e-3, np.float32)
    epochs = -(-updates // -(-len(labels) // batch)) if len(labels) else 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            row = np.repeat(np.arange(len(part)), [len(rows[j][0]) for j in part])
            column = np.concatenate([rows[j][0] for j in part])
            value = np.concatenate([rows[j][1] for j in part])
            first = np.searchsorted(row, np.arange(len(part)))
            error = (model.scores(row, column, value, len(part)) - labels[part]).astype(np.float32) * weight[part]
            vx = model.factors[column] * value[:, None]
            sums = np.add.reduceat(vx, first, axis=0)
            slope = error[row] * value
            used, where = np.unique(column, return_inverse=True)
            by_feature = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[by_feature], np.arange(len(used)))
            each = np.column_stack((slope, slope[:, None] * (sums[row] - vx)))[by_feature]
            grad = np.add.reduceat(each, cut, axis=0) / len(part)
            w, v = grad[:, 0] + decay * model.linear[used], grad[:, 1:] + decay * model.factors[used]
            seen_w[used] += w**2
            seen_v[used] += v**2
            model.linear[used] -= rate * w / np.sqrt(seen_w[used])
            model.factors[used] -= rate * v / np.sqrt(seen_v[used])
            model.bias -= 0.2 * rate * float(error.mean())
    return model


def metadata_bins(docs: DataFrame, columns: tuple[str, ...]):
    """Metadata as hashed bins, an array<int> column: values as they are, numbers by sign and power of two; a null is a value of its own."""
    bins = []
    for name in columns:
        value = F.col(name)
        if isinstance(docs.schema[name].dataType, NumericType):
            value = F.concat(F.signum(value).cast("int").cast("string"), F.lit(":"), F.floor(F.log2(F.abs(value.cast("double")) + 1)).cast("string"))
        bins.append(F.pmod(F.xxhash64(F.lit(name), F.coalesce(value.cast("string"), F.lit(""))), F.lit(META)).cast("int"))
    return F.array(*bins) if bins else F.array().cast("array<int>")


def _chunks(texts, meta):
    """Runs of texts of bounded size: ((bytes, offsets, metadata), range of rows)."""
    raw, at = byte_column(texts)
    if isinstance(meta, pa.ChunkedArray):
        meta = meta.combine_chunks()
    bins = np.asarray(meta.flatten()).reshape(len(texts), -1) if len(texts) else np.zeros((0, 0), np.int64)
    for a, b in slices(np.diff(at).tolist(), CHUNK):
        yield (raw[at[a] : at[b]], at[a : b + 1] - at[a], bins[a:b].astype(np.int64)), slice(a, b)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = (), max_docs: int = 4000, keep_id=None, **options) -> FactorisationMachine:
    """Train on at most ``max_docs`` labelled documents, those of least id hash among the ids that ``keep_id`` admits.

    Features are computed where the texts are; sparse rows alone are ordered and
    reach the driver, those of that bounded sample only.  A null label or id is
    no label; of several labels for one id the largest counts.
    """
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    if keep_id is not None:
        marks = marks.filter(keep_id(F.col("id")))
    # the ids are chosen before any text is read: a bounded table
    chosen = marks.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_docs)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), metadata_bins(docs, metadata).alias("meta")).join(F.broadcast(chosen), "id")
    sample = sample.select("text", "meta", "label", F.xxhash64("id").alias("h"), F.xxhash64("text").alias("k"))

    def vectors(batches):
        for got in batches:
            for texts, columns in _chunks(got.column(0), got.column(1)):
                row, column, value = features(*texts)
                first = np.append(np.searchsorted(row, np.arange(len(texts[1]) - 1)), len(row))
                lists = lambda x, first=first: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x))
                rest = [got.column(i).slice(columns.start, columns.stop - columns.start) for i in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([lists(column.astype(np.int32)), lists(value), *rest], ["column", "value", "label", "h", "k"])

    sparse = sample.mapInArrow(vectors, "column array<int>, value array<float>, label int, h long, k long")
    # only the rows of repeated ids could exceed the bound
    got = sparse.orderBy("h", "k").limit(max_docs).select("column", "value", "label").toArrow()
    rows = [(np.asarray(c.values), np.asarray(v.values)) for c, v in zip(got.column("column"), got.column("value"), strict=True)]
    return train(rows, np.asarray(got.column("label"), dtype=np.float32), **options)


def score(docs: DataFrame, model: FactorisationMachine, *, text_col: str = "text", metadata: tuple[str, ...] = (), threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    ``metadata`` names the columns that the model was fitted with.  Null and
    empty texts are scored by their (empty) structure and metadata; whole texts
    are read, very long ones too, one at a time; repeated rows score alike; an
    empty table gives an empty result; existing columns of the two names are
    replaced, all others kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x (rank + 1) floats

    @F.pandas_udf("double")
    def of(texts: pd.Series, meta: pd.Series) -> pd.Series:
        found = [np.zeros(0)]
        bins = pa.array(list(meta), pa.list_(pa.int32()))
        for chunk, _ in _chunks(pa.array(texts, pa.binary()), bins):
            found.append(shared.value.scores(*features(*chunk), len(chunk[1]) - 1))
        return pd.Series(np.concatenate(found))

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*kept, of.asNondeterministic()(F.col(text_col).cast("binary"), metadata_bins(docs, metadata)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit_and_score(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), threshold: float = 0.3, **options) -> DataFrame:
    """Learn from documents whose id's CRC-32 mod ``folds`` isn't ``held_out``; score all.

    ``metadata`` names columns of ``docs`` that are features beside the text.
    Returns the columns of ``docs`` plus ``held_out``, ``score``, ``predicted``.
    """
    apart = lambda x: id_crc(x) % folds == held_out
    model = fit(docs, labels, id_col=id_col, text_col=text_col, metadata=metadata, keep_id=lambda x: ~apart(x), **options)
    return score(docs.withColumn("held_out", apart(F.col(id_col))), model, text_col=text_col, metadata=metadata, threshold=threshold)
