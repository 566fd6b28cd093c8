"""Adapters: the driver's tables as readings, calls, requests and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STALE = 21600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ASSET = """CASE event_type WHEN 'click' THEN 'XLM' WHEN 'view' THEN 'USDC' WHEN 'purchase' THEN 'BTC'
            WHEN 'signup' THEN 'ETH' ELSE 'USDT' END"""
SOURCE = """CASE user_id % 4 WHEN 0 THEN 'chainlink' WHEN 1 THEN 'redstone'
             WHEN 2 THEN 'band' ELSE 'reflector' END"""

READINGS_SQL = f"""readings AS (
  SELECT event_id AS seq, {ASSET} AS asset, {SOURCE} AS source,
         CAST(CAST(value AS DECIMAL(20,2)) * 100000000 AS DECIMAL(38,0)) AS price,
         8 AS decimals, epoch_us(ts) // 1000000 AS timestamp
  FROM events), newest AS (SELECT max(timestamp) AS t FROM readings)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", f"{ASSET} AS asset", f"{SOURCE} AS source",
        "CAST(CAST(value AS DECIMAL(20,2)) * 100000000 AS DECIMAL(38,0)) AS price",
        "8 AS decimals", "unix_timestamp(CAST(ts AS TIMESTAMP)) AS timestamp",
    )


def as_of(df: DataFrame, column: str = "timestamp") -> Column:
    """Newest time of the table, as a scalar subquery."""
    return df.agg(F.max(column).alias("t")).scalar()


def with_readings(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([READINGS_SQL, *ctes]) + "\n" + body


# Larger series for throughput: one reading per order line.
LINES_SQL = """readings AS (
  SELECT l_orderkey * 10 + l_linenumber AS seq, 'A' || CAST(l_partkey % 50 AS VARCHAR) AS asset,
         'S' || CAST(l_suppkey % 4 AS VARCHAR) AS source,
         CAST(CAST(l_extendedprice AS DECIMAL(20,2)) * 100 AS DECIMAL(38,0)) AS price, 2 AS decimals,
         epoch_us(l_shipdate) // 1000000 AS timestamp
  FROM lineitem)"""


def line_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS seq", "'A' || CAST(l_partkey % 50 AS STRING) AS asset",
        "'S' || CAST(l_suppkey % 4 AS STRING) AS source",
        "CAST(CAST(l_extendedprice AS DECIMAL(20,2)) * 100 AS DECIMAL(38,0)) AS price", "2 AS decimals",
        "unix_timestamp(CAST(l_shipdate AS TIMESTAMP)) AS timestamp",
    )


# Orders have a unique key, so they also serve where the order must be total.
ORDERS_SQL = """readings AS (
  SELECT o_orderkey AS seq, 'A' || CAST(o_custkey % 50 AS VARCHAR) AS asset, 'S' || CAST(o_orderkey % 4 AS VARCHAR) AS source,
         CAST(CAST(o_totalprice AS DECIMAL(20,2)) * 100 AS DECIMAL(38,0)) AS price, 2 AS decimals,
         epoch_us(o_orderdate) // 1000000 AS timestamp
  FROM orders)"""


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS seq", "'A' || CAST(o_custkey % 50 AS STRING) AS asset",
        "'S' || CAST(o_orderkey % 4 AS STRING) AS source",
        "CAST(CAST(o_totalprice AS DECIMAL(20,2)) * 100 AS DECIMAL(38,0)) AS price", "2 AS decimals",
        "unix_timestamp(CAST(o_orderdate AS TIMESTAMP)) AS timestamp",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: latency in seconds, timestamp in ms."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "concat('/', event_type) AS endpoint", "'GET' AS method",
        "lpad(CAST(user_id AS STRING), 10, '0') AS api_key_prefix",
        "CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS asset",
        "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status",
        "value / 100 AS latency_s", "unix_millis(CAST(ts AS TIMESTAMP)) AS timestamp",
    )


REQUESTS_SQL = """requests AS (
  SELECT event_id AS seq, '/' || event_type AS endpoint, 'GET' AS method,
         lpad(CAST(user_id AS VARCHAR), 10, '0') AS api_key_prefix,
         CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS asset,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         value / 100 AS latency_s, epoch_us(ts) // 1000 AS timestamp FROM events)"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component checks; every 17th event marks the component degraded instead."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "concat('component-', user_id % 3) AS component",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms",
        "CASE WHEN event_id % 17 = 0 THEN 'degraded' ELSE 'check' END AS kind",
        "event_type <> 'error' AS ok",
    )


CHECKS_SQL = """checks AS (
  SELECT event_id AS seq, 'component-' || CAST(user_id % 3 AS VARCHAR) AS component, epoch_us(ts) // 1000 AS ts_ms,
         CASE WHEN event_id % 17 = 0 THEN 'degraded' ELSE 'check' END AS kind, event_type <> 'error' AS ok
  FROM events)"""


def feed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        f"{SOURCE} AS source", f"{ASSET} AS asset", "event_id AS seq",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms", "event_type <> 'error' AS ok", "value / 10 AS latency_s",
    )


CALLS_SQL = f"""calls AS (
  SELECT {SOURCE} AS source, {ASSET} AS asset, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms,
         event_type <> 'error' AS ok, value / 10 AS latency_s FROM events)"""
