"""A training corpus from `documents`: language, exact copies, near copies, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from atalaya.llm import exact_dedup as dedup, jaccard, langid, mixing, packing
from atalaya.llm.common import small_batches, stored, table
from atalaya.llm.queries import MIX_SEED, MIX_SHARE, MIX_WEIGHTS, tokenizer_files

#: A text is rejected if it has no letter or if its main language covers less than this share of its letters.
MIN_LANG_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts in which no language covers half of the letters."""
    small_batches(spark)
    tagged = langid.tag(docs, langid.train(docs))
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANG_SHARE)
    return tagged.where(sure).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the one with the largest doc_id."""
    return dedup.exact_dedup(docs).where("kept").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles in common) stays: the one with the smallest doc_id.

    SimHash fingerprints and their pigeonring keys bring pairs together, MinHash those that differ in more bits; exact Jaccard decides.
    """
    small_batches(spark)
    return jaccard.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token budgets by domain, language and source; no text is repeated, so one epoch at most."""
    return mixing.mix_sources(docs, MIX_WEIGHTS, MIX_SHARE, 1, MIX_SEED).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, each with its sequence and offset."""
    small_batches(spark)
    return packing.pack_documents(docs, *tokenizer_files()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned languages, fingerprints and packing are not expressible in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
