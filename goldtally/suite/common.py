"""Shared pieces of the driver-table queries: table loading and the gold /
prediction derivations.  Every derivation is a plain expression over the
whole table, written once for Spark here and once in SQL (``SQL_*``) for the
DuckDB oracle, so both engines score identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- customer: gold and prediction P(customer) ---------------------------------

CUSTOMER_FIELDS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def customer_gold(cust: DataFrame) -> DataFrame:
    return cust.select(F.col("c_custkey").alias("record_id"), F.col("c_custkey").alias("seq"),
                       *CUSTOMER_FIELDS)


def customer_pred(cust: DataFrame) -> DataFrame:
    """Prediction derived from gold: 1/13 missing, names altered (k%7), balances
    off by one (k%11), nation dropped (k%17), segment lower-cased (k%5); an
    older all-null copy for k%19 (seq 0, must lose to the newer one), and an
    extra keyless copy for k%23."""
    k = F.col("c_custkey")
    current = cust.where(k % 13 != 0).select(
        k.alias("record_id"), F.lit(1).alias("seq"),
        F.when(k % 7 == 0, F.concat(F.col("c_name"), F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 17 == 0, F.lit(None).cast("int")).otherwise(F.col("c_nationkey")).alias("c_nationkey"),
        F.when(k % 11 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 5 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    older = cust.where(k % 19 == 0).select(
        k.alias("record_id"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("c_name"),
        F.lit(None).cast("int").alias("c_nationkey"), F.lit(None).cast("double").alias("c_acctbal"),
        F.lit(None).cast("string").alias("c_mktsegment"))
    keyless = cust.where(k % 23 == 0).select(
        F.lit(None).cast("long").alias("record_id"), F.lit(2).alias("seq"), *CUSTOMER_FIELDS)
    return current.unionByName(older).unionByName(keyless)


SQL_CUSTOMER = """
gold AS (SELECT c_custkey AS record_id, c_custkey AS seq, c_name, c_nationkey, c_acctbal, c_mktsegment
         FROM customer),
pred_raw AS (
  SELECT c_custkey AS record_id, 1 AS seq,
         CASE WHEN c_custkey % 7 = 0 THEN c_name || '!' ELSE c_name END AS c_name,
         CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
         CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment
  FROM customer WHERE c_custkey % 13 <> 0
  UNION ALL
  SELECT c_custkey, 0, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 19 = 0
  UNION ALL
  SELECT NULL, 2, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 23 = 0),
pred AS (SELECT * FROM pred_raw WHERE record_id IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) = 1),
matched AS (
  SELECT g.record_id, g.seq,
         (g.c_name IS NOT DISTINCT FROM p.c_name) AS o_c_name,
         (g.c_nationkey IS NOT DISTINCT FROM p.c_nationkey) AS o_c_nationkey,
         (g.c_acctbal IS NOT DISTINCT FROM p.c_acctbal) AS o_c_acctbal,
         (g.c_mktsegment IS NOT DISTINCT FROM p.c_mktsegment) AS o_c_mktsegment
  FROM gold g JOIN pred p ON g.record_id = p.record_id),
card AS (
  """ + "\n  UNION ALL ".join(
    f"SELECT '{f}' AS field, sum(o_{f}::INT)::BIGINT AS matches, count(*)::BIGINT AS total FROM matched"
    for f in CUSTOMER_FIELDS) + """)
"""


def sql_pct(m: str, t: str) -> str:
    return f"CASE WHEN {t} > 0 THEN {m}::DOUBLE / {t}::DOUBLE * 100.0 ELSE 0.0 END"
