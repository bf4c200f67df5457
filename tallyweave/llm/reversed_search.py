"""Ranked search with the roles exchanged: an index over the queries, and every document is streamed through it.

The items (queries) are few and the documents many, so the inverted index holds
the items' terms.  One pass counts each document's terms that some item has; the
totals give the terms' weights; a second pass sends each document's counts
through the index, which adds up its score for every item that shares a term.  A
task keeps the best documents of each item in a heap of bounded size, and the
tasks' heaps are merged in two steps.  No document is ever sent to an item.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, release_memory, token_blocks

#: Bytes of item terms in one index; more items than fit are searched for in blocks, each by a pass of its own.
MOST_BYTES = 32_000_000
#: Scores computed in one go, and the parts in which an item's heaps are merged first.
BATCH_SCORES = 2_000_000
MERGE_PARTS = 32
#: Letters, digits and bytes from 0x80 on are in terms, A-Z in lower case; all other bytes separate them.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_in(text: pa.Scalar) -> Iterator[list[bytes]]:
    """The terms of a text, block by block; null text has none."""
    if text.is_valid:
        yield from token_blocks(text.as_buffer().to_pybytes().translate(TERM_BYTES))


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of each item id."""
    kind = items.schema[item_col].dataType

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                seen = {term for block in terms_in(text) for term in block}
                yield pa.record_batch({"item": pa.array([item.as_py()] * len(seen), to_arrow_type(kind)), "term": pa.array(list(seen), pa.binary())})

    slim = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(split, f"item {kind.simpleString()}, term binary").distinct()


class ItemIndex:
    """The inverted index of a block of items: per term the numbers of the items that hold it."""

    def __init__(self, rows: Iterable[tuple[object, bytes]]):
        numbers, terms = {}, {}
        for item, term in rows:
            terms.setdefault(bytes(term), []).append(numbers.setdefault(item, len(numbers)))
        self.items = list(numbers)
        self.term_number = {term: i for i, term in enumerate(terms)}
        self.sizes = np.array([len(held) for held in terms.values()], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.holders = np.fromiter((i for held in terms.values() for i in held), np.int64, int(self.starts[-1]))
        self.weights = np.zeros(len(terms), np.int64)

    def weigh(self, documents: int, frequencies: dict[int, int]) -> None:
        """Weights floor(1000 * ln((2N + 2) / (2df + 1))); a term in no document can't score and keeps 0."""
        for term, df in frequencies.items():
            self.weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def document_counts(docs: DataFrame, index: ItemIndex, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) per document with a term: its length and how often each term of the index occurs."""

    numbers = index.term_number

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lengths, terms, tfs = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                n, hits = 0, []
                for block in terms_in(text):
                    n += len(block)
                    hits.extend(numbers[w] for w in block if w in numbers)
                if n:
                    found, times = np.unique(np.array(hits, np.int32), return_counts=True)
                    kept.append(i)
                    lengths.append(n)
                    terms.append(found)
                    tfs.append(times)
            yield pa.record_batch({"id": batch.column(0).take(pa.array(kept, pa.int64())), "n": pa.array(lengths, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64()))})
            release_memory()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "id long, n long, terms array<int>, tfs array<long>")


class Heaps:
    """The best documents of every item: by score, then id, null ids last."""

    def __init__(self, items: int, most: int):
        self.most, self.least = most, np.ones(items, np.int64)  # a score under ``least`` can't enter
        self.item, self.score, self.doc, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, scores: np.ndarray, docs: np.ndarray, nulls: np.ndarray) -> None:
        """Scores (documents x items) of some documents."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]])
        doc, null = np.concatenate([self.doc, docs[row]]), np.concatenate([self.null, nulls[row]])
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        first = np.searchsorted(item, item)
        kept = np.arange(len(item)) - first < self.most
        self.item, self.score, self.doc, self.null = item[kept], score[kept], doc[kept], null[kept]
        full = np.bincount(self.item, minlength=len(self.least)) == self.most
        last = np.searchsorted(self.item, np.arange(len(self.least)), side="right") - 1
        self.least[full] = self.score[last[full]]


def best_in_tasks(counts: DataFrame, index: ItemIndex, documents: int, length: int, most: int, item_type) -> DataFrame:
    """(item, doc, score): the heaps of every task."""
    items, sizes, starts, holders, weights = index.items, index.sizes, index.starts, index.holders, index.weights
    arrow_type = to_arrow_type(item_type)

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(items), most)
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            docs = batch.column(0).fill_null(0).to_numpy()
            n = batch.column(1).to_numpy()
            exact = n.astype(object) if len(n) and 90 * int(n.max()) * documents >= 2**63 else n
            m = (10 + 90 * exact * documents // length).astype(np.int64)
            at = batch.column(2).offsets.to_numpy()
            terms, tfs = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            at = at - at[0]
            row = np.repeat(np.arange(len(n)), np.diff(at))
            part = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[row]))
            reach = np.concatenate([[0], np.cumsum(sizes[terms])])[at]  # index entries that the documents up to each one meet
            start = 0
            while start < len(n):
                stop = int(np.searchsorted(reach, reach[start] + BATCH_SCORES, side="right")) - 1
                stop = max(start + 1, min(stop, len(n), start + max(1, BATCH_SCORES // len(items))))
                mine = slice(at[start], at[stop])
                times = sizes[terms[mine]]
                entry = np.arange(times.sum()) + np.repeat(starts[terms[mine]] - (np.cumsum(times) - times), times)
                scores = np.zeros((stop - start) * len(items), np.int64)
                np.add.at(scores, np.repeat(row[mine] - start, times) * len(items) + holders[entry], np.repeat(part[mine], times))
                heaps.add(scores.reshape(stop - start, len(items)), docs[start:stop], null[start:stop])
                start = stop
        yield pa.record_batch({"item": pa.array([items[i] for i in heaps.item.tolist()], arrow_type), "doc": pa.array(heaps.doc, mask=heaps.null), "score": pa.array(heaps.score)})

    return counts.filter(F.size("terms") > 0).mapInArrow(stream, f"item {item_type.simpleString()}, doc long, score long")


def merge_heaps(found: DataFrame, most: int) -> DataFrame:
    """The best of each item over all tasks; in parts first, so that many tasks' heaps don't meet in one."""
    order = [F.desc("score"), F.col("doc").asc_nulls_last()]
    parts = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= most)


def rank_documents(docs: DataFrame, items: DataFrame, *, most: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``most`` best documents of every item: (item id, rank, document id, score), scores above 0 only.

    A score sums, over the distinct terms of the item, the weight of the term
    times its saturated frequency in the document, which is dampened by the
    document's length against the mean; all in whole numbers, so runs agree.
    Equal scores rank by id (a long), null ids last; repeated documents are
    ranked each, rows of one item id are one item with the terms of all, a null
    id is one item.  Null and empty texts have no terms: such a document isn't
    counted, such an item has no rows.  Whole texts are read, block by block.
    Empty tables give an empty result.  Other columns are ignored.
    """
    item_type = items.schema[item_col].dataType
    terms = cut(item_terms(items, item_col, item_text_col), "search-items")
    held = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = -(-held // MOST_BYTES)
    found = terms.limit(0).select("item", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("score"))
    for block in range(blocks):
        rows = terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).sort("item", "term").collect()  # some MOST_BYTES
        if not rows:
            continue
        index = ItemIndex(rows)
        counts = cut(document_counts(docs, index, id_col, text_col), "search-counts")
        total = counts.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if not total.documents:
            break
        index.weigh(total.documents, {r[0]: r[1] for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()})  # a row per term of the index
        found = found.unionByName(best_in_tasks(counts, index, total.documents, total.length, most, item_type))
    return merge_heaps(found, most).select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col if id_col != item_col else "doc_id"), "score")


#: The same search of ``benchmark`` items in ``documents`` as DuckDB SQL.
SEARCH_SQL = r"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, upper, lower), p) AS terms FROM documents, pattern WHERE text IS NOT NULL),
full_docs AS (SELECT r, doc_id, len(terms) AS n, terms FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM full_docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM full_docs) GROUP BY ALL),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, upper, lower), p)) AS term FROM benchmark, pattern),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM items) GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, totals),
damped AS (SELECT r, doc_id, 100 - 90 + ((90 * n * docs) // length) AS m FROM full_docs, totals),
scored AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN damped USING (r) GROUP BY item_id, r),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
