"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrail.llm import bayeslsh, centroids, crf, decontam, divergence, linealign, packing, phrasemine, sepscan, suffixtree, superkmer, urlfilter, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"))


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return divergence.judge(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_superkmer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.digests(_read(spark, sf_dir, "documents"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(_read(spark, sf_dir, "documents"))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return decontam.find_hits(docs, bench, keep=["doc_id"]).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, deleted lines, and the SHA-256 of what is left (null for a null text)."""
    done = linealign.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sepscan.count_tokens(_read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op10_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayeslsh.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings"))


def op12_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrasemine.mine(_read(spark, sf_dir, "documents"))


def op13_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_divergence": op2_divergence,
    "op3_superkmer_windows": op3_superkmer_windows,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_quality_crf": op5_quality_crf,
    "op6_decontamination": op6_decontamination,
    "op7_line_alignment": op7_line_alignment,
    "op8_token_counts": op8_token_counts,
    "op9_packing": op9_packing,
    "op10_minhash_bayes": op10_minhash_bayes,
    "op11_centroids": op11_centroids,
    "op12_toivonen_phrases": op12_toivonen_phrases,
    "op13_warc_index": op13_warc_index,
}
