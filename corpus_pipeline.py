"""The corpus pipeline: toxicity, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents; the last returns the packed pieces.

In every stage a null text counts as empty and comes through as null; rows without id or with a repeated one are rows like
others; texts of any length are read whole; an empty table gives an empty table; columns beside doc_id and text may have
any names and come through as they are (but n_chars, which counts anew where passages go). Each function says which of tied
and repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanguard.llm.common import documents, settled
from gleanguard.llm.exact_dedup import drop_duplicates
from gleanguard.llm.ngram_join import drop_near_duplicates
from gleanguard.llm.packing import pack
from gleanguard.llm.suffix_dedup import drop_repeated_passages
from gleanguard.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts 1 for go; it learns from the labelled documents among docs. Equal texts stay
    or go together; without labels all stay."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (after white space) the row with the smallest doc_id stays, null ids last; of rows that repeat it, one."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest doc_id stays, null ids last; of rows that repeat it, one.
    Texts without words are one class."""
    return drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur elsewhere; docs is a table of files. All rows stay, those
    whose text goes altogether with an empty one."""
    return drop_repeated_passages(docs, is_scan=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, an empty text's too; a smaller table, as workers have lived through the other
    stages. docs is a table of files."""
    return pack(docs, remembered=200_000, is_scan=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", near_dedup),
    ("suffix_dedup", passage_dedup),
    ("packing", packing),
]

#: SQL cannot express the classifier, likeness classes and packing; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as a table and read again for the next."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs, name)
    return docs
