"""The registered queries ``opN_<name>`` of this subpackage and their DuckDB SQL.

Each query applies its operator to the whole of its table and reduces the
operator's outputs (texts, spans, identifiers) to the columns reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio
from .embeddings import near_vectors
from .hmm_lm import score_texts
from .html_text import extract_main_text
from .langid import fit_and_identify
from .manifest import MANIFEST_SQL, manifest
from .mixing import MIX_SQL, mix_sources
from .packing import pack_documents
from .pii import KINDS, find_personal_data, span_list
from .quality import fit_and_score
from .repeats import remove_repeats
from .reversed_search import SEARCH_SQL, rank_documents
from .simhash import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary ``name`` is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_mixing(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), cap=3.0)
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


ORACLES["op5_mixing"] = f"WITH docs AS (SELECT * FROM documents), {MIX_SQL} SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM mixed"


@query
def op9_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return fit_and_identify(docs).select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return fit_and_score(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",)).select("doc_id", "held_out", "score", "predicted")


@query
def op2_packing(spark, sf_dir):
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op7_embedding_dedup(spark, sf_dir):
    found = near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLES["op7_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fit AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS n, vec_id AS r FROM v UNION SELECT reach.n, links.y FROM reach JOIN links ON reach.r = links.x),
named AS (SELECT n AS vec_id, min(r) AS component_id FROM reach GROUP BY n),
counted AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM named LEFT JOIN counted ON x = vec_id"""


@query
def op3_html_text(spark, sf_dir):
    pages = extract_main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_hmm_scores(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


@query
def op4_suffix_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"), width=200)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_audio_fingerprints(spark, sf_dir):
    # the media column is rendered from the vectors as it is read, a recording for each
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    prints = audio.with_fingerprint(vectors, audio_col="embedding", decode=audio.melody, more=("id",))
    return audio.align(prints, F.coalesce(F.col("id") % 50 == 0, F.lit(False))).withColumnRenamed("id", "vec_id")


@query
def op13_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # where 2 divides the checksum of the id, the text loses its line ends
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    edits = {"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    return manifest(docs, edits=edits).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLES["op13_manifest"] = MANIFEST_SQL


@query
def op12_reversed_search(spark, sf_dir):
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=10)


ORACLES["op12_reversed_search"] = SEARCH_SQL


@query
def op11_pii(spark, sf_dir):
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("pii")).alias("spans"))
