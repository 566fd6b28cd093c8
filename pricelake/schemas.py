"""Column names and types of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(38, 0)
#: Median of an even group: one exact fraction digit.
MEDIAN = T.DecimalType(38, 1)

# The watched feeds and their default fixed-point scales.
FEEDS = ("chainlink", "redstone", "band", "reflector")
FEED_DECIMALS = {"chainlink": 8, "redstone": 8, "band": 9, "reflector": 8}
WATCHED_ASSETS = ("XLM", "USDC", "BTC", "ETH", "USDT")

# Thresholds of the observed service.
POLL_SECONDS = 30
STALENESS_SECONDS = 120
INTEGRITY_STALE_SECONDS = 600
DRIFT_SECONDS = 120
CHUNK_SECONDS = 604800

READINGS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("asset", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("price", PRICE),
    T.StructField("decimals", T.IntegerType()),
    T.StructField("timestamp", T.LongType()),
])

FEED_PAYLOADS = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("asset", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("ingest_ts", T.LongType()),
])

PRICE_HISTORY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("asset", T.StringType()),
    T.StructField("price", PRICE),
    T.StructField("decimals", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("timestamp", T.LongType()),
])

HISTORY_JSON = T.StructType([
    T.StructField("price", T.StringType()),
    T.StructField("decimals", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("timestamp", T.LongType()),
])

EXPORT_ROWS = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("price", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("assetPair", T.StringType()),
])
