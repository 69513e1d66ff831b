"""The registered queries of this subpackage: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import chat, decontaminate, html_extract, lm, mixing, neardup, quality, secret_scan, substring_dedup, token_counts
from pagewright.plans.workspace import Workspace
from pagewright.sources.tables import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"), Workspace(spark, "op1"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"), Workspace(spark, "op2"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), Workspace(spark, "op3"), width=3, percent=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), token_counts.read_pieces())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), Workspace(spark, "op5"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"), Workspace(spark, "op7")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "lang", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"), Workspace(spark, "op8"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents", "doc_id", "text"), Workspace(spark, "op9"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_html_extract, op3_neardup, op4_token_counts, op5_substring_dedup, op6_chat_format, op7_secret_scan, op8_quality_rules, op9_lm_score, op10_decontaminate)}
