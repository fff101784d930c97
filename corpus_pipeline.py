"""Training corpus from raw documents: quality, language, near-duplicates, packing.

Each stage takes (spark, docs, folder) and works on all its predecessor kept; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbook.llm import importance, jaccard, language, packing
from reelbook.llm.common import read_table
from reelbook.session import stage


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is listed; rows without key stay."""
    listed = keys.select(F.col("doc_id").alias("_listed")).where(F.col("_listed").isNotNull()).distinct()
    kept = docs.join(listed, docs["doc_id"] == F.col("_listed"), "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in the importance sample."""
    found = importance.quality_sample(docs, read_table(spark, folder, "labels"))
    return _only(docs, found.where("kept"))


def languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is determined."""
    found = language.identify_languages(docs, declared="lang", host="source", markup=True)
    return _only(docs, found.where("accepted"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.first_of_each_group(docs, words=5, least=(80, 100))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids, every window in the mixture of the sources."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("language", languages), ("near_duplicates", near_duplicates), ("packing", packed)]

#: No SQL: tokenising and hashed models are beyond it; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
