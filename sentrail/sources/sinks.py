"""Fan-out of analysed messages to five tables, by batches that can be written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrail.sources.shared import written

TABLES = ["analyses", "risk_factors", "evidence", "entities", "analysis_entities"]
# How much of a text is kept as evidence, and of a fragment.
MOST_TEXT, MOST_SPAN = 2000, 255


def _put(df: DataFrame, folder: str, name: str, batch: str) -> None:
    df.write.partitionBy(batch).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/{name}")


def fan_out(analyses: DataFrame, factors: DataFrame, entities: DataFrame, folder: str, *, batch: str = "batch") -> None:
    """Writes analyses, their risk factors, evidence, entities and links of both into tables under ``folder``.

    analyses: msg_id, text, created_at, ``batch`` and what is known of a message. factors: columns of ``fusion.FACTOR``.
    entities: msg_id, type, hash, display, raw, confidence. Tables are partitioned by batch and a batch is overwritten as a
    whole, so writing it again, wholly or after a lost job, changes nothing. Rows of messages that are not in
    ``analyses`` go nowhere. Entities hold what the batch saw; ``registry_of`` adds batches up.
    """
    rows = written(analyses)
    of = rows.select("msg_id", "created_at", batch)
    put_tables(rows, factors.join(of, "msg_id"), written(entities.join(of, "msg_id")), folder, batch=batch)


def put_tables(rows: DataFrame, factors: DataFrame, found: DataFrame, folder: str, *, batch: str = "batch") -> None:
    """The tables of ``fan_out`` where factors and entities carry created_at and ``batch`` of their message already.

    All three are read as often as they are needed, so they should be tables or cheap to make of one.
    """
    _put(rows.drop("text"), folder, "analyses", batch)
    _put(factors.select("msg_id", F.col("name").alias("factor"), "family", "weight", "observed", F.substring("evidence", 1, MOST_SPAN).alias("evidence_span"), "source", batch), folder, "risk_factors", batch)
    text = F.coalesce(F.col("text"), F.lit(""))
    _put(rows.select("msg_id", F.lit("raw_text").alias("type"), F.substring(text, 1, MOST_TEXT).alias("redacted_value"), F.sha2(text, 256).alias("hash"), F.lit(False).alias("is_public"), batch), folder, "evidence", batch)
    _put(found.select("msg_id", F.col("hash").alias("entity_id"), "confidence", F.substring("raw", 1, MOST_SPAN).alias("evidence_span"), batch), folder, "analysis_entities", batch)
    seen = found.groupBy(batch, F.col("hash").alias("entity_id"), "type").agg(
        F.min_by("display", F.struct("created_at", "msg_id")).alias("display_value"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.count("*").alias("sighting_count")
    )
    _put(seen, folder, "entities", batch)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def registry_of(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each entity over all batches: entity_id, type, display_value, first_seen, last_seen, sighting_count."""
    seen = read_table(spark, folder, "entities")
    return seen.groupBy("entity_id", "type").agg(F.min_by("display_value", "first_seen").alias("display_value"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("sighting_count").alias("sighting_count"))


def analysis(spark: SparkSession, folder: str, msg_id: int, *, batch: str = "batch", of: object = None) -> DataFrame:
    """The analysis of one message; with its batch ``of``, only that partition is read. Unknown ids give no row."""
    rows = read_table(spark, folder, "analyses").where(F.col("msg_id") == msg_id)
    return rows if of is None else rows.where(F.col(batch) == of)
