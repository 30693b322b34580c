"""One query per operator, over its whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm import (
    balltree, decontaminate, html, interpolation, kdtree, mixing, simhash, tokens, toolcalls, toxicity, urls, warc, whitening,
)
from claimscope.llm.checks import CHECKS
from claimscope.llm.common import table


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = ["mix_block", "mix_phase", "mix_release", "mix_deadline", "mix_slot", "mix_row"]
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", *places)


def op2_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"), folds=10)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3, lanes=1)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5)


def op8_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link_conversations(table(spark, sf_dir, "conversations")).withColumn("errors", F.array_join("errors", ","))


def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


def op12_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


QUERIES = {
    "op1_pfair_mix": op1_pfair_mix,
    "op2_page_diff": op2_page_diff,
    "op3_lm_scores": op3_lm_scores,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_url_rules": op6_url_rules,
    "op7_toxicity": op7_toxicity,
    "op8_kdtree": op8_kdtree,
    "op9_tool_calls": op9_tool_calls,
    "op10_template_leaks": op10_template_leaks,
    "op11_whitening": op11_whitening,
    "op12_balltree": op12_balltree,
    "op13_token_counts": op13_token_counts,
}

__all__ = ["CHECKS", "QUERIES"]
