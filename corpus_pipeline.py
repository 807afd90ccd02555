"""The corpus pipeline: quality rules, exact and near deduplication, mixing, packing.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read again as the docs of the next.
All but the last return the columns of documents, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm._common import drop_tables, read, scratch, staged
from tamarack.llm.exact_dedup import drop_copies
from tamarack.llm.minhash import drop_near_copies
from tamarack.llm.mixing import training_order
from tamarack.llm.packing import pack
from tamarack.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees go.

    A null or empty text fails; repeated rows are judged alike; an empty table stays empty.
    """
    return keep_good(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays.

    A null text equals an empty one, a null doc_id is the smallest; of rows repeated in full one stays.
    """
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays.

    Documents without words are like no other and stay, null doc_ids too.
    """
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in the order of training.

    A null source is a source, the last one; documents without words take part in no mix.
    """
    return training_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences.

    Each row is packed, repeated ones too; a null text is empty and has the end token alone.
    """
    return pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", packed)]

#: Trained trees, tokens and packing are beyond SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that all stages kept. A stage's tables are deleted once the next one's are written."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, apply in STAGES[:-1]:
        with scratch(spark):
            path, docs = staged(apply(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_tables(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
