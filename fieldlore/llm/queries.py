"""Queries of the operators for training data."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession

from fieldlore.llm import boilerplate, lookalike, mixing, names, ocr_repair, pii, sentences, tokenizer
from fieldlore.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.link(table(spark, d, "mention_drafts"), table(spark, d, "seed_entities"))


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, d, "report_pages"), table(spark, d, "document_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _repeated(spark, d).select("page_id", "line_no").distinct()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.without_lines(table(spark, d, "report_pages"), _repeated(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr_repair.defects(table(spark, d, "report_pages"), table(spark, d, "document_records")).distinct()


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return ocr_repair.paragraphs(table(spark, d, "report_pages"), table(spark, d, "document_records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "document_records"), "doc_id", "clean_text").select("doc_id", "start_pos")


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    documents = sentences.sentences(table(spark, d, "document_records"), "doc_id", "clean_text").withColumnRenamed("doc_id", "record_id")
    return documents.union(sentences.sentences(table(spark, d, "report_pages"), "page_id", "raw_ocr_text").withColumnRenamed("page_id", "record_id"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "document_records").selectExpr("doc_id AS record_id", "clean_text AS text")
    return documents.union(table(spark, d, "report_pages").selectExpr("page_id AS record_id", "raw_ocr_text AS text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.items(_texts(spark, d))


def p7_masked(spark: SparkSession, d: str) -> DataFrame:
    """With the key of spark.fieldlore.pii.key; without one every run has a key of its own that nobody keeps."""
    told = spark.conf.get("spark.fieldlore.pii.key", None)
    return pii.masked(_texts(spark, d), told.encode() if told else secrets.token_bytes(32))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p9_marginals(spark: SparkSession, d: str) -> DataFrame:
    return mixing.marginals(table(spark, d, "documents"), p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.pairs(lookalike.normalized(table(spark, d, "documents")))


def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalized(table(spark, d, "documents")).select("doc_id", "canonical")


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_clean": p4_clean, "p5_found": p5_found, "p5_paragraphs": p5_paragraphs, "p6_found": p6_found, "p6_sentences": p6_sentences, "p7_found": p7_found, "p7_masked": p7_masked, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_marginals": p9_marginals, "p10_found": p10_found, "p10_canonical": p10_canonical}
ORACLES: dict[str, str] = {}
