"""From documents to packed training sequences: quality rules, toxicity, near-dedup, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.near_duplicates import near_duplicate_dedup
from foliant.llm.packing import pack_documents
from foliant.llm.quality import drop_low_quality
from foliant.llm.runtime import importable, materialise, table
from foliant.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band.

    Null and empty texts have no words and go; repeated rows are judged alike; an empty table gives an empty one.
    """
    importable(spark)
    return drop_low_quality(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold.

    Null texts score as empty ones; labels of held-out ids are never read; without a toxic label all documents stay.
    """
    return drop_toxic(docs, table(importable(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each component of documents
    whose five-word shingles are similar by 0.8 or more.

    Null and empty texts are alike; of rows repeated under one id each text stays once; rows without doc_id all stay.
    """
    importable(spark)
    return near_duplicate_dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Parts of documents with their bins.

    Null and empty texts have their end id alone; a null source conflicts with none; copies go to different bins.
    """
    importable(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]

#: The stages train models and link texts, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table; every stage's rows are written and read again."""
    docs = table(importable(spark), sf_dir, "documents")
    *others, (_, last) = STAGES
    for name, stage in others:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
