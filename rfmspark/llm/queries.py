"""Registered queries of the training-data operators: (function, DuckDB SQL or None) by name.

Every query applies its operator to its whole table; where SQL cannot express the result the query
is tested against a brute-force version in ``tests/llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rfmspark.llm import exact_topk, html_text, lexical, minhash, pii, quality_gam, quality_rules, rp_forest, suffix_dedup, token_align, window_dedup
from rfmspark.llm.bpe import encode_documents
from rfmspark.llm.common import table
from rfmspark.llm.packing import pack_documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack_documents(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.dedup_report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_gam.score(docs, quality_gam.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return encode_documents(docs, full=False)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return rp_forest.nearest(rows, rows.where("vec_id % 100 = 0"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules.quality_rules(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op11_tiled_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return exact_topk.top_products(rows, rows.where("vec_id % 100 = 0"))


def op12_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.alignment_report(table(spark, sf_dir, "documents", "doc_id", "text"))


REGISTRY = {
    "op1_suffix_dedup": (op1_suffix_dedup, None),
    "op2_pii": (op2_pii, None),
    "op3_html": (op3_html, None),
    "op4_packing": (op4_packing, None),
    "op5_window_dedup": (op5_window_dedup, None),
    "op6_quality_gam": (op6_quality_gam, None),
    "op7_bpe": (op7_bpe, None),
    "op8_minhash": (op8_minhash, None),
    "op9_rp_forest": (op9_rp_forest, None),
    "op10_quality_rules": (op10_quality_rules, None),
    "op11_tiled_topk": (op11_tiled_topk, exact_topk.SQL),
    "op12_lexical_scan": (op12_lexical_scan, lexical.SQL),
    "op13_token_align": (op13_token_align, None),
}
