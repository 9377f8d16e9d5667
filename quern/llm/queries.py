"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import read_table
from quern.llm.decontaminate import contaminated
from quern.llm.fill_in_middle import fill_in_middle, restored
from quern.llm.license_scan import scan_licenses
from quern.llm.line_dedup import duplicate_lines
from quern.llm.media_avi import media_digests
from quern.llm.ngram_join import near_duplicates
from quern.llm.oracles import SQL
from quern.llm.packing import pack_documents
from quern.llm.pii import find_pii
from quern.llm.prefix_trie import conversation_trie
from quern.llm.quality_crf import score_quality
from quern.llm.shard_shuffle import shard_digests, shuffle_shards
from quern.llm.substring_dedup import MIN_RUN_WORDS, duplicate_units
from quern.llm.token_counts import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 1024)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2048, 1)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(read_table(spark, sf_dir, "documents"))


def op6_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Short stock lines stay: a document that holds one is no copy.
    return duplicate_units(read_table(spark, sf_dir, "documents"), MIN_RUN_WORDS, MIN_RUN_WORDS)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"), with_text=True)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restored(fill_in_middle(read_table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


def op13_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digests(shuffle_shards(read_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_license_scan": op2_license_scan,
        "op3_decontaminate": op3_decontaminate,
        "op4_pack": op4_pack,
        "op5_line_dedup": op5_line_dedup,
        "op6_media_avi": op6_media_avi,
        "op7_quality": op7_quality,
        "op8_ngram_join": op8_ngram_join,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_pii": op10_pii,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_shard_shuffle": op13_shard_shuffle,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
