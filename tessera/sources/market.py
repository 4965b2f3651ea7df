"""Bars and dense panels derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .panel import densify


def bars(spark: SparkSession, sf_dir: str, by: str = "l_suppkey", unit: str = "week") -> DataFrame:
    """Open, high, low, close, volume and amount of trades, by symbol and calendar unit."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return li.groupBy(F.col(by).cast("string").alias("symbol"), F.date_trunc(unit, "l_shipdate").cast("date").alias("date")).agg(
        F.min_by(price, order).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, order).alias("c"),
        F.sum("l_quantity").cast("double").alias("v"), F.sum("l_extendedprice").cast("double").alias("amount"),
    )


def panel(spark: SparkSession, sf_dir: str, by: str = "l_suppkey", unit: str = "week", carry: bool = False) -> DataFrame:
    p = densify(bars(spark, sf_dir, by, unit))
    if carry:
        back = Window.partitionBy("symbol").orderBy("t")
        kept: list[Column] = [F.coalesce(F.col(c), F.last("c", ignorenulls=True).over(back)).alias(c) for c in "ohlc"]
        p = p.select("symbol", "t", "date", *kept, F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("amount", F.lit(0.0)).alias("amount"), "listed")
    return p


#: The same panel in DuckDB's SQL, for the oracles: columns symbol, t, date, o, h, l, c, v, amount, listed.
PANEL_SQL = """bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
    arg_min(price, k) AS o, max(price) AS h, min(price) AS l, arg_max(price, k) AS c, sum(l_quantity) AS v, sum(l_extendedprice) AS amount
  FROM (SELECT *, l_extendedprice / l_quantity AS price, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem)
  GROUP BY 1, 2),
days AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT date FROM bars)),
panel AS (
  SELECT s.symbol, d.t, d.date, b.o, b.h, b.l, b.c, b.v, b.amount, true AS listed
  FROM days d CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = d.date)"""
