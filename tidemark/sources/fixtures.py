"""Bars derived from the general tables, as Spark plans and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Daily bars by market segment from orders; time is a day.
BARS_SQL = """
SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS dt, min_by(o_totalprice, o_orderkey) AS Open, max(o_totalprice) AS High,
       min(o_totalprice) AS Low, max_by(o_totalprice, o_orderkey) AS Close, CAST(count(*) AS DOUBLE) AS Volume
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, CAST(o_orderdate AS DATE)"""

#: Indices of a day: the mean close, and the mean of the middle price.
INDEX_SQL = "SELECT dt, avg(Close) AS Market, avg((High + Low) / 2e0) AS Sector FROM bars GROUP BY dt"

#: Hourly bars by type of event.
HOURLY_SQL = """
SELECT event_type AS symbol, date_trunc('hour', ts) AS dt, min_by(value, event_id) AS Open, max(value) AS High, min(value) AS Low,
       max_by(value, event_id) AS Close, CAST(count(*) AS DOUBLE) AS Volume FROM events GROUP BY event_type, date_trunc('hour', ts)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("dt"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol"))
    return _bars(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), "o_totalprice", "o_orderkey")


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("dt"), "value", "event_id")
    return _bars(events, "value", "event_id")


def _bars(rows: DataFrame, price: str, place: str) -> DataFrame:
    return rows.groupBy("symbol", "dt").agg(
        F.min_by(price, place).alias("Open"), F.max(price).alias("High"), F.min(price).alias("Low"), F.max_by(price, place).alias("Close"), F.count("*").cast("double").alias("Volume"),
    )


def index_daily(bars: DataFrame) -> DataFrame:
    return bars.groupBy("dt").agg(F.avg("Close").alias("Market"), F.avg((F.col("High") + F.col("Low")) / 2).alias("Sector"))


def with_indices(bars: DataFrame) -> DataFrame:
    return bars.join(index_daily(bars), "dt", "left").select("symbol", "dt", "Open", "High", "Low", "Close", "Volume", "Market", "Sector")
