"""Queries over the operators of this subpackage, by the names the driver calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, pii_votes, quality, toxicity
from .common import table
from .html_extraction import extract_main_text
from .mixing import mix_counts
from .ngram_join import near_duplicate_components
from .sharding import hypergeometric_shuffle
from .token_counts import documents_rollup
from .token_files import token_output


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


def op2_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    utf8 = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return hypergeometric_shuffle(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"))


def op5_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn_from(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_rollup(spark, sf_dir)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", "held_out", "score", "predicted")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = pii_votes.found(docs, pii_votes.fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select(
        "doc_id",
        *[count(k) for k in pii_votes.KINDS],
        F.sha2(pii_votes.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii_votes.listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op10_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_html_extraction, op2_hypergeometric_sharding, op3_benchmark_decontamination, op4_ngram_jaccard_join,
        op5_token_binary_output, op6_quality_rules, op7_token_counts, op8_toxicity, op9_personal_data, op10_systematic_mixing,
    )}
