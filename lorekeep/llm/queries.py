"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import sql
from lorekeep.llm.bpe import encoding_digests
from lorekeep.llm.common import new_shared_folder, read_table, text_of
from lorekeep.llm.conversations import repaired
from lorekeep.llm.exact_dedup import exact_groups
from lorekeep.llm.mixing import mix
from lorekeep.llm.near_dedup import near_duplicates
from lorekeep.llm.pii import find_pii
from lorekeep.llm.quality_bands import quality_bands
from lorekeep.llm.rule_ensemble import quality_scores
from lorekeep.llm.spelling import spelling_variants
from lorekeep.llm.token_counts import token_counts
from lorekeep.llm.token_files import new_folder, read_token_files, write_token_files
from lorekeep.llm.toxicity import toxicity_scores
from lorekeep.llm.warc import read_archives, resolved, write_archives

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_repeats")).alias("taken"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), BYTE_PIECES)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    write_token_files(read_table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=1)
    return read_token_files(spark, path, digests=True)


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands(read_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(read_table(spark, sf_dir, "documents"), WORD_BPE)


def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.sha2(text_of("text"), 256).alias("text_sha256")
    )
    return exact_groups(docs, carry=["doc_id", "text_sha256"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(read_table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_folder(spark, "warc")
    records, _ = read_archives(write_archives(read_table(spark, sf_dir, "pages"), path), path)
    return resolved(records)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pii_spans, op2_source_mix, op3_token_counts, op4_token_files, op5_compression_bands, op6_quality_rules,
        op7_near_duplicates, op8_bpe, op9_exact_duplicates, op10_toxicity, op11_spelling_variants,
        op12_conversation_repair, op13_warc,
    )
}

SQL: dict[str, str] = {
    "op2_source_mix": sql.SOURCE_MIX,
    "op7_near_duplicates": sql.NEAR_DUPLICATES,
    "op9_exact_duplicates": sql.EXACT_DUPLICATES,
    "op11_spelling_variants": sql.SPELLING,
    "op13_warc": sql.WARC,
}
