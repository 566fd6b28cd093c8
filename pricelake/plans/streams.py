"""Streaming jobs driven to completion over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelake.plans.core import BREAKER_CTE, consensus_out, LIMIT, POLL, SERIES_CTE
from pricelake.plans.inputs import ASSET, REQUESTS_SQL, SOURCE, STALE, readings, table, with_readings
from pricelake.plans.ledgers import _recursive
from pricelake.plans.registry import ORACLES, plan
from pricelake.plans.signals import THRESHOLDS_CTE, thresholds, two_places
from pricelake.plans.tables import CUTOFF
from pricelake.session import scratch_path
from pricelake.sources import feeds, history
from pricelake.streaming import jobs, ticks


def event_stream(spark, sf):
    """The event table as a file stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def reading_stream(spark, sf):
    return event_stream(spark, sf).selectExpr(
        "event_id AS seq", f"{ASSET} AS asset", f"{SOURCE} AS source",
        "CAST(CAST(value AS DECIMAL(20,2)) * 100000000 AS DECIMAL(38,0)) AS price", "8 AS decimals",
        "unix_timestamp(CAST(ts AS TIMESTAMP)) AS timestamp")


def finish(spark, stream, name):
    path = scratch_path(spark, name)
    jobs.run_available(stream, path, scratch_path(spark, f"{name}-checkpoint"))
    return spark.read.schema(stream.schema).parquet(path)


@plan("stream_ingest", with_readings("SELECT DISTINCT asset, source, timestamp FROM readings"))
def stream_ingest(spark, sf):
    landing = scratch_path(spark, "landing")
    feeds.render_payloads(readings(spark, sf)).write.json(landing)
    schema = "seq bigint, source string, asset string, payload string, ingest_ts bigint"
    stream = jobs.stream_ingest(jobs.read_payload_stream(spark, landing, schema))
    return finish(spark, stream, "ingest").select("asset", "source", "timestamp")


def _trusted_series(staleness: int) -> str:
    """The brute-force series by breaker states, up to the last tick that the watermark passes."""
    cte = SERIES_CTE.replace(f"< {STALE}", f"< {staleness}").replace(
        "FROM readings GROUP BY 1, 2, 3)", "FROM states GROUP BY 1, 2, 3)").replace(
        "arg_max(price, seq) AS price FROM", "arg_max(price, seq) AS price, arg_max(suspicious, seq) AS susp FROM").replace(
        "r.price, r.timestamp AS ts", "r.price, r.susp, r.timestamp AS ts").replace(
        "SELECT CAST(ceil(max(timestamp) / 3600.0) AS BIGINT)", "SELECT (max(timestamp) - 120) // 3600")
    mark, rest = cte.split("mark AS (SELECT *, ")
    return mark + f"""mark0 AS (SELECT *, now - ts < {staleness} AS f0 FROM known),
mark1 AS (SELECT *, bool_or(f0 AND NOT susp) OVER w AS t1, bool_or(NOT susp) OVER w AS t2, bool_or(f0) OVER w AS f1
          FROM mark0 WINDOW w AS (PARTITION BY asset, tick)),
mark AS (SELECT *, """ + rest.replace("FROM known)", "FROM mark1)").replace(
        "WHERE fresh OR NOT any_fresh GROUP BY 1, 2)",
        "WHERE (fresh OR NOT any_fresh) AND (NOT susp OR NOT CASE WHEN f1 THEN t1 ELSE t2 END) GROUP BY 1, 2)")


_POLLED = f"""polls AS (SELECT asset, source, CAST(ceil(timestamp / {POLL}.0) AS BIGINT) AS tick,
     arg_max(CAST(price AS DOUBLE) / 1e8, seq) AS v FROM readings GROUP BY 1, 2, 3),
spread AS (SELECT asset, tick, min(v) AS lo, max(v) AS hi, count(*) AS n, string_agg(source, ',' ORDER BY source) AS polled FROM polls GROUP BY 1, 2)"""


@plan("stream_consensus", with_readings("""SELECT asset, tick, CAST(price AS VARCHAR) AS price, CAST(8 AS BIGINT) AS decimals,
   sources, timestamp, confidence, level, stale, coalesce(polled, '') AS polled, round(lo, 6) AS lowest, round(hi, 6) AS highest
   FROM series LEFT JOIN spread USING (asset, tick)""", BREAKER_CTE, _trusted_series(7200), _POLLED))
def stream_consensus(spark, sf):
    """Sources from the data, suspicious ones left out, stale ticks included."""
    stream = ticks.stream_consensus(reading_stream(spark, sf), staleness=7200, poll=POLL, limit_pct=LIMIT)
    out = finish(spark, stream, "consensus")
    return consensus_out(out, "asset", "tick").join(out.select(
        "asset", "tick", F.array_join("polled", ",").alias("polled"), F.round("lowest", 6).alias("lowest"),
        F.round("highest", 6).alias("highest")), ["asset", "tick"])


@plan("stream_usage", f"""WITH {REQUESTS_SQL}, hourly AS (
  SELECT timestamp // 3600000 * 3600000 AS hour, 'total' AS dimension, CAST(NULL AS VARCHAR) AS name, count(*) AS count FROM requests GROUP BY 1
  UNION ALL SELECT timestamp // 3600000 * 3600000, 'endpoint', method || ' ' || endpoint, count(*) FROM requests GROUP BY 1, 3
  UNION ALL SELECT timestamp // 3600000 * 3600000, 'key', api_key_prefix, count(*) FROM requests GROUP BY 1, 3
  UNION ALL SELECT timestamp // 3600000 * 3600000, 'asset', asset, count(*) FROM requests WHERE asset IS NOT NULL GROUP BY 1, 3)
SELECT hour, dimension, name, count FROM hourly WHERE hour + 3600000 <= (SELECT max(timestamp) - 600000 FROM requests)""")
def stream_usage(spark, sf):
    """All hourly counts that the watermark has passed; the sink keeps every hour."""
    stream = event_stream(spark, sf).selectExpr(
        "concat('/', event_type) AS endpoint", "'GET' AS method", "lpad(CAST(user_id AS STRING), 10, '0') AS api_key_prefix",
        "CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS asset", "unix_millis(CAST(ts AS TIMESTAMP)) AS timestamp")
    path = scratch_path(spark, "usage")
    jobs.run_usage(jobs.stream_usage(stream), path, scratch_path(spark, "usage-checkpoint"), retention_hours=None)
    return jobs.read_usage(spark, path, retention_hours=None).select("hour", "dimension", "name", "count")


@plan("stream_deliveries", """WITH d AS (SELECT epoch_us(ts) // 1000 AS ts_ms, 'hook-' || CAST(user_id % 20 AS VARCHAR) AS webhook_id,
     1 + event_id % 5 AS attempt, event_type <> 'error' AS success FROM events)
   SELECT ts_ms // 86400000 * 86400 AS day, webhook_id, attempt, count(*) AS attempts, count(*) FILTER (success) AS delivered,
     count(*) FILTER (NOT success AND attempt >= 5) AS exhausted FROM d GROUP BY 1, 2, 3
   HAVING (ts_ms // 86400000 * 86400 + 86400) * 1000 <= (SELECT max(ts_ms) - 600000 FROM d)""")
def stream_deliveries(spark, sf):
    stream = event_stream(spark, sf).selectExpr(
        "unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms", "'hook-' || CAST(user_id % 20 AS STRING) AS webhook_id",
        "1 + event_id % 5 AS attempt", "event_type <> 'error' AS success")
    return finish(spark, jobs.stream_deliveries(stream), "deliveries")


_HITS = f"""prior AS (SELECT *, lag(price) OVER (PARTITION BY asset ORDER BY tick) AS before,
    sum(CASE WHEN stale THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY tick) AS island FROM series),
streaks AS (SELECT *, row_number() OVER (PARTITION BY asset, island, stale ORDER BY tick) - 1 AS streak FROM prior),
kinds AS (
  SELECT asset, tick, 'deviation' AS kind, 'deviation' AS type, moved AS pct, CAST(before AS VARCHAR) AS prev,
         CAST(price AS VARCHAR) AS cur, CAST(NULL AS VARCHAR) AS affected,
         'Price deviation alert for ' || asset || ': ' || {two_places('moved')} || '% change' AS message
  FROM (SELECT *, abs((CAST(price AS DOUBLE) - CAST(before AS DOUBLE)) / CAST(before AS DOUBLE)) * 100 AS moved FROM prior JOIN th USING (asset))
  WHERE dev > 0 AND moved > dev
  UNION ALL SELECT asset, tick, 'stale', 'stale', NULL, NULL, NULL, NULL, 'Price data stale for ' || asset || ': ' ||
    CAST(tick * {POLL} - timestamp AS VARCHAR) || 's old (threshold: ' || CAST(stale_s AS VARCHAR) || 's)'
  FROM series JOIN th USING (asset) WHERE tick * {POLL} - timestamp > stale_s
  UNION ALL SELECT asset, tick, 'source_down', 'source_down', NULL, NULL, NULL, NULL, 'All sources down for ' || asset || ' (' ||
    CAST(streak AS VARCHAR) || ' consecutive failures)' FROM streaks JOIN th USING (asset) WHERE stale AND streak >= down
  UNION ALL SELECT asset, tick, 'disagreement', 'deviation', (hi - lo) / lo * 100, NULL, NULL, polled, 'Source disagreement for ' || asset || ': ' ||
    {two_places('(hi - lo) / lo * 100')} || '% spread across sources'
  FROM spread WHERE n > 1 AND lo > 0 AND (hi - lo) / lo * 100 > 5 AND tick <= (SELECT last FROM bounds)),
hits AS (SELECT *, tick * {POLL} AS ts FROM kinds)"""
# A kind is sent again once its hold period is over.
_HELD = """r AS (SELECT asset, kind, min(ts) AS ts FROM hits GROUP BY 1, 2
   UNION ALL SELECT asset, kind, (SELECT min(h.ts) FROM hits h WHERE h.asset = r.asset AND h.kind = r.kind AND h.ts >= r.ts + 43200) AS ts
   FROM r WHERE r.ts IS NOT NULL)"""


@plan("stream_alerts", _recursive("""SELECT asset, kind, type, ts AS timestamp, message, prev AS previous_price, cur AS current_price,
   round(pct, 6) AS deviation_percent, affected AS affected_sources FROM hits JOIN r USING (asset, kind, ts)""",
   BREAKER_CTE, _trusted_series(7200), _POLLED, THRESHOLDS_CTE, _HITS, _HELD))
def stream_alerts(spark, sf):
    """All kinds from readings to alerts in one query, each at most once per asset and 12 hours."""
    stream = ticks.stream_consensus(reading_stream(spark, sf), staleness=7200, poll=POLL, limit_pct=LIMIT)
    stream = ticks.stream_alerts(stream, thresholds(spark), period_s=43200, disagreement_pct=5.0, poll=POLL)
    out = finish(spark, stream, "alerts")
    return out.select(
        "asset", "kind", "type", "timestamp", "message", "previous_price", "current_price",
        F.round("deviation_percent", 6).alias("deviation_percent"),
        F.array_join("affected_sources", ",").alias("affected_sources"))


@plan("stream_guard", ORACLES["guard_replay"])
def stream_guard(spark, sf):
    return finish(spark, jobs.stream_guard(reading_stream(spark, sf), bps=5000), "guard").select("seq", "asset", "accepted")


@plan("stream_feed_breaker", ORACLES["feed_breaker"])
def stream_feed_breaker(spark, sf):
    calls = event_stream(spark, sf).selectExpr(
        f"{SOURCE} AS source", "event_id AS seq", "unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms", "event_type <> 'error' AS ok")
    out = finish(spark, jobs.stream_feed_breaker(calls, cooldown_ms=1_800_000), "breaker")
    return out.select("seq", "source", "allowed", "state", "failures", "trips")


@plan("cdc_after_rewrite", with_readings("""SELECT seq, asset, CAST(price AS VARCHAR) AS price, timestamp, seq % 2 AS batch
   FROM (SELECT *, row_number() OVER (PARTITION BY asset, source, timestamp, seq % 2 ORDER BY seq DESC) AS rn FROM readings)
   WHERE rn = 1"""))
def cdc_after_rewrite(spark, sf):
    """Purge, archive and a last-wins append between two exports; every change is exported once."""
    table, log, cold, target, checkpoint = (
        scratch_path(spark, n) for n in ("cdc-hot", "cdc-log", "cdc-cold", "cdc-out", "cdc-checkpoint"))
    df = readings(spark, sf)
    for batch in (0, 1):
        new = df.filter(F.col("seq") % 2 == batch)
        for _ in range(2):  # the second time as a retry
            history.sink_history_append(
                spark, new, table, on_conflict="last", changes=log, append_id=f"batch-{batch}")
        schema = spark.read.parquet(log).drop("append").schema
        jobs.cdc_incremental(spark, log, target, checkpoint, schema)
        history.retention_purge(spark, table, CUTOFF - 86400)
        history.archive_cold(spark, table, cold, cutoff=CUTOFF)
        jobs.cdc_incremental(spark, log, target, checkpoint, schema)
    out = spark.read.parquet(target)
    return out.select("seq", "asset", F.col("price").cast("string").alias("price"), "timestamp",
                      F.col("batch").cast("bigint").alias("batch"))


@plan("cdc_incremental", with_readings("SELECT seq, asset, CAST(price AS VARCHAR) AS price, timestamp, seq % 2 AS batch FROM readings"))
def cdc_incremental(spark, sf):
    """Two runs over a growing table: each exports only what is new."""
    source, target, checkpoint = (scratch_path(spark, n) for n in ("cdc-table", "cdc-out", "cdc-checkpoint"))
    df = readings(spark, sf)
    history.write_history(df.filter("seq % 2 = 0"), source)
    schema = spark.read.parquet(source).schema
    jobs.cdc_incremental(spark, source, target, checkpoint, schema)
    history.write_history(df.filter("seq % 2 = 1"), source)
    jobs.cdc_incremental(spark, source, target, checkpoint, schema)
    out = spark.read.parquet(target)
    return out.select("seq", "asset", F.col("price").cast("string").alias("price"), "timestamp",
                      F.col("batch").cast("bigint").alias("batch"))
