"""Data-quality checks on the price history and the live feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricelake.schemas import DRIFT_SECONDS, INTEGRITY_STALE_SECONDS


def _violation(df: DataFrame, kind: str, expected: Column, actual: Column, diff: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"), "asset", expected.cast("string").alias("expected"),
        actual.cast("string").alias("actual"), diff.alias("diff"))


def quality_duplicates(history: DataFrame, *, limit: int | None = None) -> DataFrame:
    """(asset, source, timestamp) keys stored more than once."""
    found = history.groupBy("asset", "source", "timestamp").agg(F.count(F.lit(1)).alias("count"))
    found = found.filter("count > 1")
    return found.orderBy("asset", "source", "timestamp").limit(limit) if limit else found


def quality_stale(history: DataFrame, *, now: Column, limit_s: int = INTEGRITY_STALE_SECONDS) -> DataFrame:
    newest = history.groupBy("asset").agg(F.max("timestamp").alias("latest_ts"))
    stale = newest.filter(F.col("latest_ts") < now - limit_s)
    return stale.withColumn("age_s", now - F.col("latest_ts"))


def quality_nonpositive(history: DataFrame) -> DataFrame:
    return history.filter(F.col("price") <= 0).select("asset", "price").distinct()


def consistency_drift(feed: DataFrame, store: DataFrame, *, limit_s: int = DRIFT_SECONDS) -> DataFrame:
    """Assets of the feed that the store lacks or holds with another time.

    Both sides have one row per asset.
    """
    both = feed.select("asset", F.col("timestamp").alias("feed_ts")).join(
        store.select("asset", F.col("timestamp").alias("store_ts")), "asset", "left")
    drift = F.abs(F.col("feed_ts") - F.col("store_ts"))
    both = both.withColumn("drift", drift).filter(F.col("store_ts").isNull() | (drift > limit_s))
    return both.withColumn("problem", F.when(F.col("store_ts").isNull(), "missing").otherwise("drift"))


def quality_violations(
    history: DataFrame, feed: DataFrame, store: DataFrame, *, now: Column,
    stale_s: int = INTEGRITY_STALE_SECONDS, drift_s: int = DRIFT_SECONDS,
) -> DataFrame:
    """Every violation in one shape: (layer, kind, asset, expected, actual, diff)."""
    dup, stale = quality_duplicates(history), quality_stale(history, now=now, limit_s=stale_s)
    bad, drift = quality_nonpositive(history), consistency_drift(feed, store, limit_s=drift_s)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    num = lambda c: F.col(c).cast("string")
    integrity = (
        _violation(dup, "duplicate", F.lit(1), F.col("count"),
                   text(num("count"), ' duplicate rows for source "', F.col("source"), '"'))
        .unionByName(_violation(stale, "stale", F.lit(f"updated within {stale_s}s"), F.col("latest_ts"),
                                text("stale by ", num("age_s"), "s")))
        .unionByName(_violation(bad, "nonpositive", F.lit("price > 0"), F.col("price"),
                                F.lit("non-positive price stored")))
        .withColumn("layer", F.lit("db-integrity"))
    )
    missing = F.col("problem") == "missing"
    feed_side = _violation(
        drift, "drift", F.when(missing, "persisted in DB").otherwise(num("feed_ts")),
        F.when(missing, "missing").otherwise(num("store_ts")),
        F.when(missing, "not found in DB").otherwise(text("timestamp drift ", num("drift"), f"s (>{drift_s}s)")),
    ).withColumn("layer", F.lit("feed-store"))
    return integrity.unionByName(feed_side)


def quality_report(violations: DataFrame) -> DataFrame:
    """Status per layer; a layer without violations is reported as ok."""
    layers = violations.sparkSession.createDataFrame([("db-integrity",), ("feed-store",)], "layer string")
    counted = violations.groupBy("layer").agg(F.count(F.lit(1)).alias("violations"))
    out = layers.join(counted, "layer", "left").select("layer", F.coalesce("violations", F.lit(0)).alias("violations"))
    bad = F.col("violations") > 0
    return out.withColumns({
        "status": F.when(bad, "violation").otherwise("ok"),
        "details": F.when(bad, F.concat(F.col("violations").cast("string"), F.lit(" violations"))).otherwise(
            "all consistent"),
    })
