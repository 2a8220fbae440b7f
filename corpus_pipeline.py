"""A training corpus in five stages: quality, exact and near duplicates, mixing, BPE ids.

Every stage reads what its predecessor wrote as Parquet in the shared folder, works on all of it and
hands on the columns of ``documents``; the last one returns ids and decoded texts, a row for every
time the mix takes a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm.bpe import encode_documents
from lorekeep.llm.common import read_table, settle
from lorekeep.llm.exact_dedup import exact_dedup
from lorekeep.llm.mixing import mixed_documents
from lorekeep.llm.near_dedup import near_dedup
from lorekeep.llm.queries import WORD_BPE
from lorekeep.llm.rule_ensemble import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    return quality_filter(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document."""
    return encode_documents(docs, WORD_BPE)


STAGES = [
    ("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("source mixing", mixing),
    ("bpe encoding", encode),
]

# trained models and token ids have no SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
