"""API usage: hourly counts, reports, top lists, traffic anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricelake.operators.chunks import top_per_key

HOUR_MS = 3_600_000
# Report windows in hours, length of top lists, anomaly settings.
PERIODS = {"daily": 24, "weekly": 168, "monthly": 720}
TOP = 10
ANOMALY_Z = 3.0
ANOMALY_HOURS = 168
MIN_POINTS = 4
RETENTION_HOURS = 24 * 90  # of hourly counts


def usage_hourly(requests: DataFrame) -> DataFrame:
    """Counts per hour: in total and by endpoint, key and asset.

    One pass with grouping sets; requests without an asset count in the total
    but not by asset.
    """
    rows = requests.select(
        (F.floor(F.col("timestamp") / HOUR_MS) * HOUR_MS).alias("hour"),
        F.concat_ws(" ", "method", "endpoint").alias("endpoint"),
        F.col("api_key_prefix").alias("key"), "asset")
    sets = [["hour"], ["hour", "endpoint"], ["hour", "key"], ["hour", "asset"]]
    cols = [[F.col(c) for c in s] for s in sets]
    grouped = rows.groupingSets(cols, "hour", "endpoint", "key", "asset").agg(
        F.count(F.lit(1)).alias("count"), F.grouping("endpoint").alias("__e"), F.grouping("key").alias("__k"),
        F.grouping("asset").alias("__a"))
    dim = (F.when(F.col("__e") == 0, "endpoint").when(F.col("__k") == 0, "key")
           .when(F.col("__a") == 0, "asset").otherwise("total"))
    named = F.when(F.col("__e") == 0, F.col("endpoint")).when(F.col("__k") == 0, F.col("key")).when(
        F.col("__a") == 0, F.col("asset"))
    out = grouped.select("hour", dim.alias("dimension"), named.alias("name"), "count")
    return out.filter((F.col("dimension") == "total") | F.col("name").isNotNull())


def usage_total(requests: DataFrame, *, since_ms: Column | None = None) -> DataFrame:
    """The `total` rows of `usage_hourly` alone: one count per hour, no grouping sets."""
    hour = F.floor(F.col("timestamp") / HOUR_MS) * HOUR_MS
    rows = requests if since_ms is None else requests.filter(hour >= since_ms)
    counted = rows.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select("hour", F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("name"), "count")


def retained(hourly: DataFrame, *, now_ms: Column, hours: int = RETENTION_HOURS) -> DataFrame:
    """Hourly counts still inside the retention."""
    return hourly.filter(F.col("hour") >= now_ms - hours * HOUR_MS)


def top_entries(counts: DataFrame, n: int = TOP) -> DataFrame:
    """Highest counts per dimension; ties in name order."""
    return top_per_key(counts, ["dimension"], [F.col("count").desc(), F.col("name").asc()], n, rank="rank")


def usage_report(hourly: DataFrame, *, now_ms: Column, period: str = "daily") -> DataFrame:
    """Total requests and top lists over the hours inside the period."""
    recent = hourly.filter(F.col("hour") >= now_ms - PERIODS[period] * HOUR_MS)
    summed = recent.groupBy("dimension", "name").agg(F.sum("count").alias("count"))
    return top_entries(summed).withColumn("period", F.lit(period))


def usage_anomalies(
    hourly: DataFrame, *, now_ms: Column, z_limit: float = ANOMALY_Z, lookback_h: int = ANOMALY_HOURS
) -> DataFrame:
    """Hours far from the mean of the lookback (at most `lookback_h` rows)."""
    points = hourly.filter((F.col("dimension") == "total") & (F.col("hour") >= now_ms - lookback_h * HOUR_MS))
    whole = W.partitionBy("dimension")
    scored = points.withColumns({
        "mean": F.avg("count").over(whole), "std": F.stddev_pop("count").over(whole), "__n": F.count("count").over(whole),
    }).filter((F.col("__n") >= MIN_POINTS) & (F.col("std") > 0))
    scored = scored.withColumn("z", (F.col("count") - F.col("mean")) / F.col("std"))
    two = lambda c: F.round(F.col(c), 2).alias
    hit = scored.filter(F.abs("z") >= z_limit)
    return hit.select("hour", "count", two("mean")("mean"), two("std")("std_dev"), two("z")("z_score"))


def affected_consumers(usage: DataFrame) -> DataFrame:
    """First use of every deprecated path by each API key."""
    keyed = usage.filter(F.col("api_key_prefix").isNotNull())
    return keyed.groupBy("path", "api_key_prefix").agg(F.min("seq").alias("first_seq"))
