"""Reading the given tables and the views derived from them.

Tables are read lazily with ``spark.read.parquet`` so Catalyst prunes columns
and pushes filters into the scan.  ``alerts`` and ``deals`` are the relational
tables of the application, derived from ``orders`` and ``lineitem`` with one
fixed rule each (see FIXTURES.md §3).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("alert_id"),
        F.col("o_orderdate").cast("date").alias("alert_date"),
        F.concat(F.lit("trader_"), F.col("o_custkey").cast("string")).alias("trader_id"),
        F.concat(F.lit("deal_"), F.col("o_orderkey").cast("string")).alias("deal_number"),
        F.concat(F.lit("model_"), (F.col("o_orderkey") % 5 + 1).cast("string")).alias("model_name"),
    )


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deals_from(load(spark, sf_dir, "lineitem"))


def deals_from(li: DataFrame) -> DataFrame:
    return li.select(
        F.col("l_orderkey").cast("string").alias("alert_id"),
        F.col("l_shipdate").cast("date").alias("deal_date"),
        F.concat(F.lit("deal_"), F.col("l_orderkey").cast("string")).alias("deal_number"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("volume"),
    )


def register_alert_views(spark: SparkSession, sf_dir: str) -> None:
    alerts(spark, sf_dir).createOrReplaceTempView("alerts_table")
    deals(spark, sf_dir).createOrReplaceTempView("deals_table")


def deal_number_filter(deal_number: str) -> Column:
    """Predicate on ``deal_number`` stated on the stored key when possible.

    ``deal_number`` is derived from ``l_orderkey``; a predicate on the derived
    text cannot reach the Parquet scan, the equivalent one on the key can.
    """
    key = deal_number[5:]
    if deal_number.startswith("deal_") and key.isdigit() and str(int(key)) == key:
        return F.col("l_orderkey") == int(key)
    return F.concat(F.lit("deal_"), F.col("l_orderkey").cast("string")) == deal_number
