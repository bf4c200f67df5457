"""A training corpus from ``documents``: filtered, deduplicated, mixed and packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes each stage's result as
Parquet in the shared folder and reads it back for the next.  Missing columns of
``documents`` are an error; nulls in any of them, empty and repeated rows pass
through the stages as their operators say; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import cut, unused
from tallyweave.llm.langid import NO_LETTER, fit_and_identify
from tallyweave.llm.mixing import mix_sources
from tallyweave.llm.packing import pack_documents
from tallyweave.llm.registry import tokenizer_path
from tallyweave.llm.repeats import remove_repeats
from tallyweave.llm.simhash import keep_first


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null, empty or letterless texts) go; a missing ``lang`` is filled in."""
    found = fit_and_identify(docs).filter(F.col("lang_pred") != NO_LETTER)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near duplicates the document of smallest id stays."""
    return keep_first(docs, words=3, radius=3)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur twice are cut out; documents without a word left go.

    A character of which only a part would stay goes as a whole (as do
    replacement characters of a text that is cut).  ``n_chars`` is
    that of the text that stays; documents without repeats keep theirs.
    """
    # the other columns go through the operator as one struct, in the place of the id
    whole = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    found = remove_repeats(whole, id_col="row", text_col="text", width=200)
    text = F.when(F.size("removed") > 0, valid_text(F.col("kept"))).otherwise(F.col("kept").cast("string"))
    kept = found.withColumn("text", text).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    count = F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[{"text": F.col("text"), "n_chars": count.alias("n_chars")}.get(c, F.col(f"row.{c}").alias(c)) for c in docs.columns])


def valid_text(raw):
    """UTF-8 bytes as text without the remains of characters that were cut."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�", "")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 in turn; a document appears as often as the mix takes it."""
    mixed = mix_sources(docs, weights=(5.0, 2.0, 1.0), cap=3.0).filter("mix.copies > 0")
    return mixed.withColumn(unused(mixed, "copy"), F.explode(F.sequence(F.lit(1), F.col("mix.copies")))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece of a document."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("language", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", repeated_passage_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenisation, SimHash and suffix automata have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
