"""Registered queries of these operators: thin functions of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelbook.llm import bpe, cosine, divergence, hilbert, huffman, impact, importance, jaccard, language, mixing, packing, phrases, warc
from reelbook.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_hilbert_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 runs of a Hilbert curve through language, source and size."""
    return hilbert.hilbert_shards(read_table(spark, folder, "documents"), 24)


@query
def op2_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded by backtracking and decoded by the offset table."""
    return bpe.round_trip(read_table(spark, folder, "documents"))


@query
def op3_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 4096 ids, every window in the mixture of the sources."""
    return packing.pack_documents(read_table(spark, folder, "documents"))


@query
def op8_huffman_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents through Huffman-coded files."""
    return huffman.coded_round_trip(read_table(spark, folder, "documents"))


@query
def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents by 4-word shingles at a similarity of 0.85."""
    return jaccard.near_duplicates(read_table(spark, folder, "documents"), words=4, least=(85, 100))


@query
def op4_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five best integer inner products of every fiftieth vector with all others."""
    return impact.exact_top_k(read_table(spark, folder, "embeddings"))


@query
def op7_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links of all vectors at cosine 0.95 and their components."""
    return cosine.near_duplicate_vectors(read_table(spark, folder, "embeddings"))


@query
def op5_warc_normaliser(spark: SparkSession, folder: str) -> DataFrame:
    """All pages through archives: one gzip stream, a member per record, read by index."""
    return warc.archive_round_trip(read_table(spark, folder, "pages"))


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents from text, declared language and source."""
    return language.identify_languages(read_table(spark, folder, "documents"), declared="lang", host="source", markup=True)


@query
def page_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all pages from text, markup, address suffix and host."""
    return language.identify_languages(read_table(spark, folder, "pages"), key="page_id", text="html", url="url", markup=True)


@query
def op10_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weight of all documents against the labelled target, and the sample."""
    return importance.quality_sample(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op12_pareto_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How often every document is taken so that sources weigh 5, 2, 1 in code-point order."""
    return mixing.mix_sources(read_table(spark, folder, "documents"))


ORACLES["op12_pareto_mixing"] = mixing.twin_sql()


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of every pair of sources of a language, and the terms by which a source stands out."""
    return divergence.audit_sources(read_table(spark, folder, "documents"))


ORACLES["op13_source_divergence"] = divergence.twin_sql()


@query
def op11_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 best phrases of two to four words in each language of all documents."""
    return phrases.phrases(read_table(spark, folder, "documents"))


ORACLES["op11_phrase_mining"] = phrases.twin_sql()
