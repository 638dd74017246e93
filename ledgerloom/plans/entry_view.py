"""The ledger entry view over the given tables; one text that both Spark and the oracle engine run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import table

ENTRY = """
SELECT o_orderkey AS row_idx,
 CASE WHEN o_orderkey % 97 = 0 THEN 'Unnamed retailer of ' ELSE '' END || c_name || CASE o_orderkey % 8 WHEN 1 THEN ' Pte Ltd' WHEN 2 THEN ' Group Singapore' WHEN 3 THEN ' (Asia)' WHEN 4 THEN ' Platforms'
  WHEN 5 THEN ' Asia Pacific Ltd' WHEN 6 THEN ' Pâtisserie' WHEN 7 THEN ' Bar  & Grill' ELSE '' END AS company,
 CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_announced,
 CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 AS INT) AS STRING) END AS date_reported,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS DOUBLE) END AS jobs_cut_sg,
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice / 100) AS DOUBLE) END AS jobs_cut_global,
 CASE WHEN o_orderkey % 8 = 0 THEN CAST(o_orderkey % 120 AS DOUBLE) END AS pct_workforce,
 c_mktsegment AS industry,
 CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'http://web.archive.org/web/2024/' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.' ELSE 'http://' END
  || CASE WHEN o_orderkey % 9 = 0 THEN 'reuters.com' ELSE 'Site' || CAST(o_custkey % 50 AS STRING) || '.example.com' END || '/story/' || CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS STRING)
  || CASE o_orderkey % 5 WHEN 1 THEN '/amp' WHEN 2 THEN '?utm=1' WHEN 3 THEN '/index.html' WHEN 4 THEN '/' ELSE '' END END AS source_link,
 CASE o_orderkey % 9 WHEN 0 THEN '[gn:story ' || CAST(o_orderkey % 400 AS STRING) || ']' WHEN 1 THEN 'expected to cut roles' WHEN 2 THEN 'a global headcount figure' WHEN 3 THEN 'potential duplicate of another row' ELSE '' END AS notes,
 CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'rumored' ELSE 'reference' END AS status,
 CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'cust-' || CAST(o_custkey AS STRING) || '-' || substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) END AS event_id
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ENTRY, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


def oracle_entry() -> str:
    return ENTRY.format(orders="orders", customer="customer")
