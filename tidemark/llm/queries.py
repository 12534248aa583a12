"""The queries of this folder's operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (decontaminate, exact_dedup, line_dedup, mixing, ngram_join, oracles, ranked_search, secret_scan, substring_dedup,
                          token_counts, token_output, toxicity, warc, whitening)
from tidemark.llm.common import table


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_archives(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.grace_dedup(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))



def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, *toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_substring_dedup, op3_secret_scan, op4_warc_revisits, op5_decontamination, op6_token_output,
    op7_exact_dedup, op8_toxicity, op9_ngram_join, op10_source_mix, op11_token_counts,
    op12_ranked_search, op13_embedding_whitening)}

ORACLES: dict[str, str] = {
    "op1_line_dedup": oracles.LINES, "op2_substring_dedup": oracles.SUBSTRINGS, "op4_warc_revisits": oracles.WARC,
    "op7_exact_dedup": oracles.EXACT, "op9_ngram_join": oracles.JACCARD, "op12_ranked_search": oracles.SEARCH}
