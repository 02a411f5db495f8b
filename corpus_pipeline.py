"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Cases.  Each stage keeps to its operator's: a null or empty text is scored by
the quality model and goes with the languages, as it has none; a null id is
kept by every filter that its text passes and is never a near copy; of
repeated rows one stays; an empty table passes through every stage; columns
beside those of documents come through the first four under their own names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.language import keep_identified
from tessera.llm.mixing import mixed_documents
from tessera.llm.nearcopies import keep_one_of_each
from tessera.llm.packing import pack
from tessera.llm.quality import keep_good
from tessera.llm.runtime import discard, mark, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier predicts good."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_each(docs, words=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in the curriculum's order."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every word of every document."""
    return pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: Learnt models and BK-trees can't be put in SQL; the tests hold run() against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what a stage wrote beside its result, and its predecessor's result, are deleted once it is done."""
    docs = table(spark, sf_dir, "documents")
    since = mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, since, keep=docs)
    return docs
