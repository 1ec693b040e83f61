"""The corpus pipeline: documents pass through the stages in order, each written as Parquet and read again.

Every stage takes all rows that the one before it kept, and its decisions take effect. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrail.llm import bayeslsh, crf, decontam, linealign, packing
from sentrail.llm._text import numbered, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line field scores under its cutoff."""
    field = crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, (text,) = numbered(docs, "text")
    return crf.score(rows, field, keep=rows.columns, text=text).where(F.col("score") >= crf.CUTOFF).select(*rows.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes aligned blocks from later documents; one that loses all its words goes, n_chars follows the text."""
    rows, (text, doc_id) = numbered(docs, "text", "doc_id")
    cut = linealign.dedup_lines(rows, text=text, doc_id=doc_id)
    left = cut.where((F.col("n_removed") == 0) | F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        of = numbered(docs, "n_chars")[1][0]
        left = left.withColumn(of, F.when(F.col("n_removed") > 0, F.char_length(text).cast("long")).otherwise(F.col(of)))
    return left.select(*rows.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of every group of near-duplicates."""
    return bayeslsh.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with an occurrence of a benchmark window."""
    return decontam.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents into sequences of power-of-two length."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: A field that is trained and a tokenizer can't be put into SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
