"""Streaming forms of the operators, and the job that drives them.

Consensus and alerts are in `ticks`. Event time is explicit everywhere: late rows are dropped by the watermark in the
stream and still picked up when a batch recomputes the range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pricelake.operators.sequential import (
    CLOSED, COOLDOWN_MS, FAILURE_THRESHOLD, GUARD_BPS, HALF_OPEN_SUCCESSES, _call, _within,
)
from pricelake.operators import usage
from pricelake.operators.usage import HOUR_MS, RETENTION_HOURS
from pricelake.schemas import FEED_PAYLOADS
from pricelake.sources import files
from pricelake.sources.feeds import scan_feed_payloads

LATENESS_SECONDS = 120
DAY_MS = 24 * HOUR_MS
USAGE_TABLE = "hour bigint, dimension string, name string, count bigint, day bigint, batch bigint"


def run_available(stream: DataFrame, path: str, checkpoint: str, *, partition_by: list[str] | None = None) -> None:
    """Process what is there now into a Parquet table, then stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start(path).awaitTermination()


def start(stream: DataFrame, path: str, checkpoint: str, *, every: str = "30 seconds") -> StreamingQuery:
    """The same as a running job, polled at the feed interval."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start(path)


def read_payload_stream(spark: SparkSession, path: str, schema=FEED_PAYLOADS, *, files_per_batch: int | None = None
                        ) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def stream_ingest(payloads: DataFrame, *, lateness_s: int = LATENESS_SECONDS) -> DataFrame:
    """Payload stream -> readings, one per (asset, source, timestamp)."""
    readings = scan_feed_payloads(payloads).withColumn("event_time", F.timestamp_seconds("timestamp"))
    kept = readings.withWatermark("event_time", f"{lateness_s} seconds")
    return kept.dropDuplicatesWithinWatermark(["asset", "source", "timestamp"])


def stream_usage(requests: DataFrame, *, lateness: str = "10 minutes") -> DataFrame:
    """Hourly request counts in total and by endpoint, key and asset."""
    part = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("name"))
    parts = F.array(
        part("total", F.lit(None).cast("string")), part("endpoint", F.concat_ws(" ", "method", "endpoint")),
        part("key", F.col("api_key_prefix")), part("asset", F.col("asset")))
    rows = requests.withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", lateness)
    rows = rows.select("event_time", F.explode(parts).alias("p")).select("event_time", "p.*")
    rows = rows.filter((F.col("dimension") == "total") | F.col("name").isNotNull())
    counted = rows.groupBy(F.window("event_time", "1 hour"), "dimension", "name").agg(F.count(F.lit(1)).alias("count"))
    return counted.select((F.unix_timestamp("window.start") * 1000).alias("hour"), "dimension", "name", "count")


def run_usage(
    counts: DataFrame, path: str, checkpoint: str, *, retention_hours: int | None = RETENTION_HOURS
) -> None:
    """Process what is there now into a table that forgets hours beyond the retention (None: keeps all).

    `counts` is a `stream_usage`. Files lie by day and micro-batch, so a batch that is run again
    overwrites its own and a day goes by its folder; what an expiry that was stopped has left goes
    with the next one. `read_usage` gives the retained hours to the hour.
    """
    spark = counts.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"day": F.floor(F.col("hour") / DAY_MS) * DAY_MS, "batch": F.lit(batch_id)})
        # A day and its batch in few files; Spark splits those that are far larger than others.
        writer = rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch").parquet(path)
        if retention_hours is not None:
            expire_usage(spark, path, retention_hours=retention_hours)

    query = counts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def read_usage(spark: SparkSession, path: str, *, retention_hours: int | None = RETENTION_HOURS) -> DataFrame:
    """The hourly counts that end less than `retention_hours` before the newest one does (None: all)."""
    table = spark.read.schema(USAGE_TABLE).parquet(path)
    if retention_hours is None:
        return table.drop("day", "batch")
    newest = table.agg(F.max("hour").alias("hour")).scalar()
    return usage.retained(table, now_ms=newest + HOUR_MS, hours=retention_hours).drop("day", "batch")


def expire_usage(spark: SparkSession, path: str, *, retention_hours: int = RETENTION_HOURS) -> None:
    """Remove the days that lie before the retention of the newest day; reads folder names only."""
    days = {int(folder.rsplit("=", 1)[1]): folder for folder in files.glob(spark, f"{path}/day=*")}
    for day, folder in days.items():
        if day + DAY_MS <= max(days) - retention_hours * HOUR_MS:
            files.remove(spark, folder)


def stream_deliveries(log: DataFrame, *, max_attempts: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """Daily delivery outcomes per webhook and attempt number."""
    rows = log.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", lateness)
    counted = rows.groupBy(F.window("event_time", "1 day"), "webhook_id", "attempt").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("delivered"),
        F.count_if(~F.col("success") & (F.col("attempt") >= max_attempts)).alias("exhausted"))
    return counted.select(F.unix_timestamp("window.start").alias("day"), "webhook_id", "attempt", "attempts",
                          "delivered", "exhausted")


FRAME_ROWS = 10_000


def _keyed(stream: DataFrame, key: str, fold: Callable, output: str, state: str) -> DataFrame:
    return stream.groupBy(key).applyInPandasWithState(
        fold, output, state, "append", GroupStateTimeout.NoTimeout)


def _slim(values: pd.Series) -> np.ndarray:
    """Values as an array of numbers; objects only where they are no 64-bit integers."""
    found = values.to_numpy()
    if found.dtype == object:
        try:
            return np.array([int(v) for v in found], np.int64)
        except (OverflowError, TypeError, ValueError):
            pass
    return found


def _in_order(frames: Iterator[pd.DataFrame], columns: list[str], rows: int = FRAME_ROWS) -> Iterator[tuple[list, ...]]:
    """A key's rows of one micro-batch by `seq`, as lists of at most `rows` values of each column.

    What is held is a few bytes a row: the input goes as soon as its frame is taken over, and rows
    become Python values one stretch at a time.
    """
    held: list[list[np.ndarray]] = [[] for _ in columns]
    for frame in frames:
        for column, parts in zip(columns, held):
            parts.append(_slim(frame[column]))
    arrays = []
    for parts in held:
        arrays.append(np.concatenate(parts))
        parts.clear()
    order = np.argsort(arrays[0])  # rows without a number come last
    for at in range(0, len(order), rows):
        yield tuple(a[order[at : at + rows]].tolist() for a in arrays)


def stream_guard(submissions: DataFrame, *, bps: int = GUARD_BPS) -> DataFrame:
    """guard_replay on a stream: the state is the last accepted price per asset."""

    def fold(key, frames, state: GroupState):
        previous = int(state.get[0]) if state.exists else None
        for seqs, prices in _in_order(frames, ["seq", "price"]):
            accepted = []
            for price in map(int, prices):
                ok = _within(price, previous, bps)
                accepted.append(ok)
                if ok:
                    previous = price
            yield pd.DataFrame({"asset": key[0], "seq": [int(s) for s in seqs], "accepted": accepted})
        state.update((str(previous),))

    slim = submissions.select("asset", "seq", F.col("price").cast("string").alias("price"))
    return _keyed(slim, "asset", fold, "asset string, seq bigint, accepted boolean", "previous string")


def stream_feed_breaker(
    calls: DataFrame, *, threshold: int = FAILURE_THRESHOLD, cooldown_ms: int = COOLDOWN_MS,
    successes: int = HALF_OPEN_SUCCESSES,
) -> DataFrame:
    """feed_breaker on a stream of calls."""

    def fold(key, frames, state: GroupState):
        name, wins, failures, at, trips = state.get if state.exists else (CLOSED, 0, 0, None, 0)
        now = (name, wins, failures, at)
        for seqs, times, oks in _in_order(frames, ["seq", "ts_ms", "ok"]):
            out = []
            for seq, ts, ok in zip(seqs, times, oks):
                now, allowed, more = _call(now, ts, ok, threshold, cooldown_ms, successes)
                trips += more
                out.append((key[0], seq, allowed, now[0], now[2], trips))
            yield pd.DataFrame(out, columns=["source", "seq", "allowed", "state", "failures", "trips"])
        state.update((*now, trips))

    slim = calls.select("source", "seq", "ts_ms", "ok")
    return _keyed(slim, "source", fold,
                  "source string, seq bigint, allowed boolean, state string, failures bigint, trips bigint",
                  "name string, wins bigint, failures bigint, failed_at bigint, trips bigint")


def cdc_incremental(spark: SparkSession, table: str, target: str, checkpoint: str, schema) -> None:
    """Export what was added to a history table since the last run.

    `table` is a folder to which files are only added: the change log of
    `sink_history_append` (or a table that is never rewritten; purges, archives and
    last-wins appends rewrite files, which would be exported again).

    The checkpoint is the offset; every micro-batch overwrites its own folder, so
    a batch that is run again after a failure leaves no duplicates.
    """

    def export(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    changes = spark.readStream.schema(schema).parquet(table)
    query = changes.writeStream.foreachBatch(export).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
