"""Registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, hnsw, mixing, packing, pieces, pii, quality, simhash, templates, topk, toxicity, urls
from .common import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best matches of every 20th vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return templates.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    rules = spark.createDataFrame(urls.RULES, "rule_host string, rule_path string, verdict string")
    listed = spark.createDataFrame(urls.LISTED, "rule_host string, rule_path string")
    judged = urls.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules, listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, and its toxic spans as start:end in code points, comma-joined."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return toxicity.score_documents(docs, labels).withColumns({"n_spans": F.size("toxic_spans"), "toxic_spans": spans})


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all vectors."""
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled encodings of every document."""
    return pieces.report(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers' tokens of every document, aligned."""
    return alignment.report(_table(spark, sf_dir, "documents"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, step by step, for each language."""
    return audit.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": op1_topk,
        "op2_templates": op2_templates,
        "op3_url_filter": op3_url_filter,
        "op4_simhash": op4_simhash,
        "op5_pii": op5_pii,
        "op6_toxicity": op6_toxicity,
        "op7_hnsw": op7_hnsw,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_quality": op9_quality,
        "op10_mixing": op10_mixing,
        "op11_alignment": op11_alignment,
        "op12_audit": op12_audit,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": topk.SQL,
        "op3_url_filter": urls.SQL,
        "op10_mixing": mixing.SQL,
        "op12_audit": audit.SQL,
    }
