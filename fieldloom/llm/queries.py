"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import convrepair, decontaminate, filteraudit, htmltext, langid, mixing, nndescent, passages, pii, secrets, simhash, tokenpack, toxicity
from fieldloom.llm.common import scratch_path, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "op4-tokens")
    tokenpack.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenpack.summary(spark, path)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.main_text(pages, htmltext.fit(pages))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs), spans=False)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.repair(convrepair.damage(table(spark, sf_dir, "conversations")))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_token_packing": op4_token_packing,
    "op5_html_extraction": op5_html_extraction,
    "op6_secret_scan": op6_secret_scan,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_language_id": op8_language_id,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_personal_data": op12_personal_data,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op7_benchmark_decontamination": decontaminate.ORACLE,
    "op9_embedding_near_dedup": nndescent.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
    "op11_conversation_repair": convrepair.ORACLE,
    "op13_filter_audit": filteraudit.ORACLE,
}
