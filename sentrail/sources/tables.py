"""Tables of the driver's data as the inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Messages made from orders; the same SQL runs in Spark and in DuckDB.
MSG_SQL = """
SELECT o_orderkey AS msg_id, o_custkey AS cust, o_orderdate AS created_at, CASE o_orderkey % 8
 WHEN 0 THEN 'Dear SBI customer, your KYC has expired. Update immediately at http://sbi-kyc-' || CAST(o_custkey % 40 AS STRING) || '.xyz/login or your account will be blocked within 24 hours.'
 WHEN 1 THEN 'DHL: consignment held at customs. Pay Rs.' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' to help' || CAST(o_custkey % 25 AS STRING) || '@ybl immediately.'
 WHEN 2 THEN 'Unga account KYC kaalavadhi mudinjiduchu. Udane http://hdfc-verify-' || CAST(o_custkey % 30 AS STRING) || '.top/update la update pannunga illana account block aagidum.'
 WHEN 3 THEN 'This is RBI officer speaking. Legal action pending. Call 9' || lpad(CAST(o_custkey AS STRING), 9, '0') || ' now to avoid arrest.'
 WHEN 4 THEN 'உங்கள் கணக்கு இன்று முடக்கப்படும். உடனே http://amaz0n-login-' || CAST(o_custkey % 20 AS STRING) || '.cam/verify இல் சரிபார்க்கவும்.'
 WHEN 5 THEN 'Rs.' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' debited from A/c XX4521 on 14-02-26 to VPA grocery@okicici. Do not share your OTP with anyone.'
 WHEN 6 THEN 'Congratulations! You have won Rs.5 lakh in the lucky draw. Mail claim' || CAST(o_custkey % 15 AS STRING) || '@prize-desk.club, txn id REF' || lpad(CAST(o_orderkey AS STRING), 8, '0') || '. Velachery branch.'
 ELSE CAST(o_orderkey AS STRING) || ' 12345' END AS text
FROM orders
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows that are long to judge to at least four tasks a core; a small file would be read by one or two tasks."""
    tasks = 4 * max(df.sparkSession.sparkContext.defaultParallelism, 8)
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, cust, created_at, text."""
    orders = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
    return spark.sql(MSG_SQL.replace("FROM orders", "FROM {orders}"), orders=orders)
