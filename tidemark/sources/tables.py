"""Parquet tables by name, and the market view of them that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def daily_prices(spark: SparkSession, folder: str) -> DataFrame:
    """stock_id, day, close, value: one row a stock and trading day."""
    l = table(spark, folder, "lineitem")
    return l.groupBy(F.col("l_partkey").alias("stock_id"), F.to_date("l_shipdate").alias("day")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_extendedprice").alias("value"))


def members(spark: SparkSession, folder: str) -> DataFrame:
    """theme_id, stock_id, role, cap: brands as themes."""
    p = table(spark, folder, "part")
    return p.select(F.col("p_brand").alias("theme_id"), F.col("p_partkey").alias("stock_id"), F.when(F.col("p_size") <= 25, "CORE").otherwise("RELATED").alias("role"), (F.col("p_retailprice") * F.col("p_size")).alias("cap"))


def yearly_returns(spark: SparkSession, folder: str, first: int, second: int) -> DataFrame:
    """stock_id, ret: price of the second year over that of the first, less 1; null where either is missing."""
    l = table(spark, folder, "lineitem").where(F.year("l_shipdate").isin(first, second))
    price = lambda y: F.try_divide(F.sum(F.when(F.year("l_shipdate") == y, F.col("l_extendedprice"))), F.sum(F.when(F.year("l_shipdate") == y, F.col("l_quantity"))))
    return l.groupBy(F.col("l_partkey").alias("stock_id")).agg((price(second) / price(first) - 1).alias("ret"))
