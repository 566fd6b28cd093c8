"""Anomalies, alerts, data quality, health, objectives and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelake.functions import decimals as D
from pricelake.operators import alerts, anomaly, consensus, health, quality, usage
from pricelake.plans.core import BREAKER_CTE, POLL, SERIES_CTE, series, states
from pricelake.plans.inputs import (
    CALLS_SQL, CHECKS_SQL, REQUESTS_SQL, as_of, checks, feed_calls, order_readings, ORDERS_SQL, readings, requests,
    with_readings,
)
from pricelake.plans.registry import plan
from pricelake.session import materialize

SCORES_CTE = """vals AS (SELECT asset, tick, CAST(price AS DOUBLE) / 1e8 AS v FROM series),
rets AS (SELECT *, lag(v) OVER w AS last_v, CASE WHEN lag(v) OVER w <> 0 THEN (v - lag(v) OVER w) / lag(v) OVER w END AS ret
         FROM vals WINDOW w AS (PARTITION BY asset ORDER BY tick)),
frames AS (SELECT *, count(*) OVER f AS n, avg(v) OVER f AS mean, stddev_pop(v) OVER f AS sd,
             stddev_pop(ret) OVER g AS vol, count(ret) OVER g AS nret FROM rets
           WINDOW f AS (PARTITION BY asset ORDER BY tick ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
                  g AS (PARTITION BY asset ORDER BY tick ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)),
scores AS (SELECT asset, tick,
    CASE WHEN sd < 1e-12 THEN 0 ELSE abs((v - mean) / sd) END / 3.0 AS z_score,
    CASE WHEN mean = 0 THEN 0 ELSE abs(v - mean) / mean * 100 END / 5.0 AS ma_score,
    CASE WHEN last_v = 0 THEN 0 ELSE abs((v - last_v) / last_v) END AS jump, vol * 3.0 AS lim, nret
  FROM frames WHERE n >= 5),
dets AS (SELECT asset, tick, z_score, z_score > 1 AS z_hit, ma_score, ma_score > 1 AS ma_hit,
    CASE WHEN nret > 0 AND lim > 1e-12 THEN jump / lim ELSE 0 END AS vol_score,
    nret > 0 AND jump > lim + 1e-15 AS vol_hit FROM scores)"""


def values(spark, sf):
    """The consensus table, stored once: the detectors read it more than once."""
    value = D.as_float(F.col("price"), F.col("decimals")).alias("value")
    return materialize(series(spark, sf).select("asset", "tick", value), "consensus")


def _detector(short):
    return with_readings(f"SELECT asset, tick, round({short}_score, 6) AS score, {short}_hit AS is_anomaly FROM dets",
                         SERIES_CTE, SCORES_CTE)


def _shown(df):
    return df.select("asset", "tick", F.round("score", 6).alias("score"), "is_anomaly")


@plan("anomaly_zscore", _detector("z"))
def anomaly_zscore(spark, sf):
    return _shown(anomaly.anomaly_zscore(values(spark, sf)))


@plan("anomaly_moving_avg", _detector("ma"))
def anomaly_moving_avg(spark, sf):
    return _shown(anomaly.anomaly_moving_avg(values(spark, sf)))


@plan("anomaly_volatility", _detector("vol"))
def anomaly_volatility(spark, sf):
    return _shown(anomaly.anomaly_volatility(values(spark, sf)))


@plan("anomaly_best", with_readings("""SELECT asset, tick, method, round(score, 6) AS score FROM (
   SELECT *, row_number() OVER (PARTITION BY asset, tick ORDER BY score DESC, r DESC) AS rn FROM (
     SELECT asset, tick, 'zscore' AS method, z_score AS score, 0 AS r FROM dets WHERE z_hit UNION ALL
     SELECT asset, tick, 'moving_average', ma_score, 1 FROM dets WHERE ma_hit UNION ALL
     SELECT asset, tick, 'volatility', vol_score, 2 FROM dets WHERE vol_hit)) WHERE rn = 1""", SERIES_CTE, SCORES_CTE))
def anomaly_best(spark, sf):
    return anomaly.anomaly_best(values(spark, sf)).select("asset", "tick", "method", F.round("score", 6).alias("score"))


@plan("anomaly_orders", f"""WITH {ORDERS_SQL}, series AS (SELECT asset, seq AS tick, price * 1000000 AS price FROM readings),
   {SCORES_CTE} SELECT asset, tick, round(z_score, 6) AS z_score, round(ma_score, 6) AS ma_score FROM dets""")
def anomaly_orders(spark, sf):
    """Detectors over the order series, in sequence order."""
    df = order_readings(spark, sf).select("asset", F.col("seq").alias("tick"), (F.col("price").cast("double") / 100).alias("value"))
    out = anomaly.score_series(df).filter(F.col("z_score").isNotNull())
    return out.select("asset", "tick", F.round("z_score", 6).alias("z_score"), F.round("ma_score", 6).alias("ma_score"))


@plan("false_positive_rate", with_readings("""SELECT asset, round(avg(CASE WHEN seq % 3 = 0 THEN 0.0 ELSE 1.0 END), 6) AS rate
   FROM readings GROUP BY 1"""))
def false_positive_rate(spark, sf):
    feedback = readings(spark, sf).select("asset", (F.col("seq") % 3 == 0).alias("is_true"))
    return anomaly.false_positive_rate(feedback).select("asset", F.round("rate", 6).alias("rate"))


def thresholds(spark):
    rows = [("BTC", 40.0, 7200.0, 2.0), ("ETH", 60.0, 1800.0, 1.0), ("XLM", 0.0, 3600.0, 1.0)]
    return spark.createDataFrame(rows, "asset string, deviation_pct double, stale_s double, source_down double")


THRESHOLDS_CTE = "th(asset, dev, stale_s, down) AS (VALUES ('BTC', 40.0, 7200, 2), ('ETH', 60.0, 1800, 1), ('XLM', 0.0, 3600, 1))"


@plan("join_thresholds", with_readings("SELECT asset, tick, CAST(dev AS DOUBLE) AS deviation_pct FROM series JOIN th USING (asset)",
                                       SERIES_CTE, THRESHOLDS_CTE))
def join_thresholds(spark, sf):
    return alerts.join_thresholds(series(spark, sf), thresholds(spark)).select("asset", "tick", "deviation_pct")


_DEV = """devalert AS (SELECT asset, tick, p, c, abs((c - p) / p) * 100 AS moved FROM (
     SELECT asset, tick, CAST(price AS DOUBLE) AS c, CAST(lag(price) OVER (PARTITION BY asset ORDER BY tick) AS DOUBLE) AS p
     FROM series) JOIN th USING (asset) WHERE dev > 0 AND abs((c - p) / p) * 100 > dev)"""


@plan("alert_deviation", with_readings(f"SELECT asset, tick * {POLL} AS timestamp, 'deviation' AS type, round(moved, 6) AS deviation_percent FROM devalert",
                                       SERIES_CTE, THRESHOLDS_CTE, _DEV))
def alert_deviation(spark, sf):
    out = alerts.alert_deviation(materialize(series(spark, sf), "consensus"), thresholds(spark), poll=POLL)
    return out.select("asset", "timestamp", "type", F.round("deviation_percent", 6).alias("deviation_percent"))


@plan("alert_stale", with_readings(f"""SELECT asset, tick * {POLL} AS timestamp, 'Price data stale for ' || asset || ': ' ||
   CAST(tick * {POLL} - timestamp AS VARCHAR) || 's old (threshold: ' || CAST(stale_s AS VARCHAR) || 's)' AS message
   FROM series JOIN th USING (asset) WHERE tick * {POLL} - timestamp > stale_s""", SERIES_CTE, THRESHOLDS_CTE))
def alert_stale(spark, sf):
    out = alerts.alert_stale(series(spark, sf), thresholds(spark), poll=POLL)
    return out.select("asset", "timestamp", "message")


_SPARSE = SERIES_CTE.replace("< 21600", "< 3600")
_DOWN = """isl AS (SELECT asset, tick, stale, sum(CASE WHEN stale THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY tick) AS island FROM series),
pos AS (SELECT *, row_number() OVER (PARTITION BY asset, island, stale ORDER BY tick) - 1 AS streak FROM isl)"""


@plan("alert_source_down", with_readings(f"""SELECT asset, tick * {POLL} AS timestamp, 'All sources down for ' || asset || ' (' ||
   CAST(streak AS VARCHAR) || ' consecutive failures)' AS message FROM pos JOIN th USING (asset) WHERE stale AND streak >= down""",
   _SPARSE, THRESHOLDS_CTE, _DOWN))
def alert_source_down(spark, sf):
    out = alerts.alert_source_down(materialize(series(spark, sf, staleness=3600), "consensus"), thresholds(spark), poll=POLL)
    return out.select("asset", "timestamp", "message")


_DISAGREE = f"""spread AS (SELECT asset, tick, min(v) AS lo, max(v) AS hi, count(*) AS n, string_agg(source, ',' ORDER BY source) AS sources
   FROM (SELECT asset, source, CAST(ceil(timestamp / {POLL}.0) AS BIGINT) AS tick,
                arg_max(CAST(price AS DOUBLE) / 1e8, seq) AS v FROM readings GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@plan("alert_disagreement", with_readings(f"""SELECT asset, tick * {POLL} AS timestamp, round((hi - lo) / lo * 100, 6) AS deviation_percent,
   sources AS affected_sources FROM spread WHERE n >= 2 AND lo > 0 AND (hi - lo) / lo * 100 > 5""", _DISAGREE))
def alert_disagreement(spark, sf):
    out = alerts.alert_disagreement(readings(spark, sf), poll=POLL)
    return out.select("asset", "timestamp", F.round("deviation_percent", 6).alias("deviation_percent"),
                      F.array_join("affected_sources", ",").alias("affected_sources"))


def two_places(x: str) -> str:
    """Text of a double with two digits, half up on its shortest decimal form."""
    return f"CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,15)) AS DECIMAL(38,2))::VARCHAR"


def all_alerts(spark, sf):
    """All four kinds over one series with a short staleness limit."""
    sparse = materialize(series(spark, sf, staleness=3600), "consensus")
    found = [alerts.alert_deviation(sparse, thresholds(spark), poll=POLL), alerts.alert_stale(sparse, thresholds(spark), poll=POLL),
             alerts.alert_source_down(sparse, thresholds(spark), poll=POLL), alerts.alert_disagreement(readings(spark, sf), poll=POLL)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("deviation_percent", F.round("deviation_percent", 6))


_ALERTS = f"""al AS (
   SELECT asset, tick * {POLL} AS timestamp, 'deviation' AS type, 'Price deviation alert for ' || asset || ': ' || {two_places('moved')} || '% change' AS message,
     CAST(before AS VARCHAR) AS prev, CAST(price AS VARCHAR) AS cur, round(moved, 6) AS pct, CAST(NULL AS VARCHAR) AS affected
   FROM (SELECT *, abs((CAST(price AS DOUBLE) - CAST(before AS DOUBLE)) / CAST(before AS DOUBLE)) * 100 AS moved FROM (
       SELECT *, lag(price) OVER (PARTITION BY asset ORDER BY tick) AS before FROM series) JOIN th USING (asset)) WHERE dev > 0 AND moved > dev
   UNION ALL SELECT asset, tick * {POLL}, 'stale', 'Price data stale for ' || asset || ': ' ||
     CAST(tick * {POLL} - timestamp AS VARCHAR) || 's old (threshold: ' || CAST(stale_s AS VARCHAR) || 's)', NULL, NULL, NULL, NULL
   FROM series JOIN th USING (asset) WHERE tick * {POLL} - timestamp > stale_s
   UNION ALL SELECT asset, tick * {POLL}, 'source_down', 'All sources down for ' || asset || ' (' || CAST(streak AS VARCHAR) ||
     ' consecutive failures)', NULL, NULL, NULL, NULL FROM pos JOIN th USING (asset) WHERE stale AND streak >= down
   UNION ALL SELECT asset, tick * {POLL}, 'deviation', 'Source disagreement for ' || asset || ': ' || {two_places('(hi - lo) / lo * 100')} ||
     '% spread across sources', NULL, NULL, round((hi - lo) / lo * 100, 6), sources FROM spread WHERE n >= 2 AND lo > 0 AND (hi - lo) / lo * 100 > 5),
bodies AS (SELECT *, CASE type WHEN 'source_down' THEN 'critical' ELSE 'warning' END AS severity, '{{"timestamp":' || timestamp || ',"asset":"' || asset ||
   '","type":"' || type || '","message":"' || message || '"' || coalesce(',"previousPrice":"' || prev || '"', '') ||
   coalesce(',"currentPrice":"' || cur || '"', '') || coalesce(',"deviationPercent":' || pct::VARCHAR, '') ||
   coalesce(',"affectedSources":["' || replace(affected, ',', '","') || '"]', '') || '}}' AS body FROM al)"""


@plan("alert_route", with_readings("""SELECT asset, timestamp, channel, asset || ':' || type AS dedup_key, severity,
   CASE channel WHEN 'chat' THEN '{"text":":rotating_light: *' || upper(type) || '* — ' || message || '"}'
     WHEN 'email' THEN '{"to":["a@example.org","b@example.org"],"subject":"[Price Alert] ' || type || ' for ' || asset || '","text":"' || message || '"}'
     WHEN 'pager' THEN '{"event_action":"trigger","dedup_key":"' || asset || ':' || type || '","payload":{"summary":"' || message ||
       '","source":"pricelake","severity":"' || severity || '","custom_details":' || body || '}}'
     ELSE body END AS payload
   FROM bodies, (VALUES ('chat'), ('pager'), ('email'), ('webhook')) c(channel)""", _SPARSE, THRESHOLDS_CTE, _DOWN, _DISAGREE, _ALERTS))
def alert_route(spark, sf):
    out = alerts.alert_route(all_alerts(spark, sf), recipients=("a@example.org", "b@example.org"))
    return out.select("asset", "timestamp", "channel", "dedup_key", "severity", "payload")


@plan("alert_history", with_readings("""SELECT asset, timestamp, type, message, prev AS previous_price, cur AS current_price, pct AS deviation_percent,
   affected AS affected_sources FROM al ORDER BY timestamp DESC, asset, type, message LIMIT 100""",
                                     _SPARSE, THRESHOLDS_CTE, _DOWN, _DISAGREE, _ALERTS))
def alert_history(spark, sf):
    return alerts.alert_history(all_alerts(spark, sf)).select(
        "asset", "timestamp", "type", "message", "previous_price", "current_price", "deviation_percent",
        F.array_join("affected_sources", ",").alias("affected_sources"))


_HOURS = "hist AS (SELECT *, timestamp // 3600 * 3600 AS hour FROM readings)"


def hourly_history(spark, sf):
    """Readings floored to the hour (keys collide), every 50th price negated."""
    df = readings(spark, sf).withColumn("timestamp", F.floor(F.col("timestamp") / 3600) * 3600)
    return df.withColumn("price", F.when(F.col("seq") % 50 == 0, F.lit(0).cast(D.WIDE) - F.col("price")).otherwise(F.col("price")))


@plan("quality_duplicates", with_readings("SELECT asset, source, hour AS timestamp, count(*) AS count FROM hist GROUP BY 1, 2, 3 HAVING count(*) > 1", _HOURS))
def quality_duplicates(spark, sf):
    return quality.quality_duplicates(hourly_history(spark, sf))


@plan("quality_stale", with_readings("""SELECT asset, max(timestamp) AS latest_ts, (SELECT t FROM newest) - max(timestamp) AS age_s
   FROM readings GROUP BY 1 HAVING max(timestamp) < (SELECT t FROM newest) - 600"""))
def quality_stale(spark, sf):
    df = readings(spark, sf)
    return quality.quality_stale(df, now=as_of(df))


@plan("quality_nonpositive", with_readings("SELECT DISTINCT asset, CAST(-price AS VARCHAR) AS price FROM readings WHERE seq % 50 = 0"))
def quality_nonpositive(spark, sf):
    out = quality.quality_nonpositive(hourly_history(spark, sf))
    return out.select("asset", F.col("price").cast("string").alias("price"))


_STORE = """feed AS (SELECT asset, max(timestamp) AS ts FROM readings GROUP BY 1),
store AS (SELECT asset, max(timestamp) AS ts FROM readings WHERE seq % 10 < 7 AND asset <> 'USDT' GROUP BY 1),
drift AS (SELECT f.asset, f.ts AS feed_ts, s.ts AS store_ts, abs(f.ts - s.ts) AS d FROM feed f LEFT JOIN store s USING (asset)
          WHERE s.ts IS NULL OR abs(f.ts - s.ts) > 120)"""


def feed_and_store(spark, sf):
    df = readings(spark, sf)
    store = df.filter((F.col("seq") % 10 < 7) & (F.col("asset") != "USDT"))
    return consensus.latest_per_asset(df), consensus.latest_per_asset(store)


@plan("consistency_drift", with_readings("""SELECT asset, feed_ts, store_ts, d AS drift,
   CASE WHEN store_ts IS NULL THEN 'missing' ELSE 'drift' END AS problem FROM drift""", _STORE))
def consistency_drift(spark, sf):
    return quality.consistency_drift(*feed_and_store(spark, sf))


_VIOLATIONS = """violations AS (
  SELECT 'db-integrity' AS layer, 'duplicate' AS kind, asset, '1' AS expected, CAST(count(*) AS VARCHAR) AS actual,
         CAST(count(*) AS VARCHAR) || ' duplicate rows for source "' || source || '"' AS diff
  FROM hist GROUP BY asset, source, hour HAVING count(*) > 1
  UNION ALL SELECT 'db-integrity', 'stale', asset, 'updated within 600s', CAST(max(hour) AS VARCHAR),
         'stale by ' || CAST((SELECT t FROM newest) - max(hour) AS VARCHAR) || 's' FROM hist GROUP BY asset
         HAVING max(hour) < (SELECT t FROM newest) - 600
  UNION ALL SELECT DISTINCT 'db-integrity', 'nonpositive', asset, 'price > 0', CAST(-price AS VARCHAR), 'non-positive price stored'
         FROM readings WHERE seq % 50 = 0
  UNION ALL SELECT 'feed-store', 'drift', asset, CASE WHEN store_ts IS NULL THEN 'persisted in DB' ELSE CAST(feed_ts AS VARCHAR) END,
         coalesce(CAST(store_ts AS VARCHAR), 'missing'),
         coalesce('timestamp drift ' || CAST(d AS VARCHAR) || 's (>120s)', 'not found in DB') FROM drift)"""


def violations(spark, sf):
    return quality.quality_violations(hourly_history(spark, sf), *feed_and_store(spark, sf), now=as_of(readings(spark, sf)))


@plan("quality_violations", with_readings("SELECT layer, kind, asset, expected, actual, diff FROM violations", _HOURS, _STORE, _VIOLATIONS))
def quality_violations(spark, sf):
    return violations(spark, sf).select("layer", "kind", "asset", "expected", "actual", "diff")


@plan("quality_report", with_readings("""SELECT layer, CAST(n AS BIGINT) AS violations, CASE WHEN n > 0 THEN 'violation' ELSE 'ok' END AS status,
   CASE WHEN n > 0 THEN CAST(n AS VARCHAR) || ' violations' ELSE 'all consistent' END AS details
   FROM (SELECT l.layer, count(v.layer) AS n FROM (VALUES ('db-integrity'), ('feed-store')) l(layer)
         LEFT JOIN violations v USING (layer) GROUP BY 1)""", _HOURS, _STORE, _VIOLATIONS))
def quality_report(spark, sf):
    return quality.quality_report(violations(spark, sf))


HEALTH_CTE = f"""{CALLS_SQL}, oks AS (SELECT source, max(CASE WHEN ok THEN seq END) AS ok_seq FROM calls GROUP BY 1),
health AS (SELECT c.source, count(*) AS total_requests, count(*) FILTER (NOT ok) AS total_failures,
    max(CASE WHEN ok THEN ts_ms END) // 1000 AS last_success, max(CASE WHEN NOT ok THEN ts_ms END) // 1000 AS last_failure,
    count(*) FILTER (ok_seq IS NULL OR seq > ok_seq) AS consecutive_failures,
    CAST(floor((1 - count(*) FILTER (NOT ok) / CAST(count(*) AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS uptime_pct
  FROM calls c JOIN oks USING (source) GROUP BY 1)"""


@plan("source_health", f"WITH {HEALTH_CTE} SELECT *, consecutive_failures < 3 AS healthy FROM health")
def source_health(spark, sf):
    return health.source_health(feed_calls(spark, sf))


@plan("sla_breaches", f"WITH {CALLS_SQL} SELECT source, count(*) FILTER (ok AND latency_s > 5) AS breaches FROM calls GROUP BY 1")
def sla_breaches(spark, sf):
    return health.sla_breaches(feed_calls(spark, sf))


@plan("fleet_status", f"""WITH {HEALTH_CTE} SELECT CASE WHEN bool_and(consecutive_failures < 3) THEN 'healthy'
   WHEN bool_or(consecutive_failures < 3) THEN 'degraded' ELSE 'unhealthy' END AS status FROM health""")
def fleet_status(spark, sf):
    return health.fleet_status(health.source_health(feed_calls(spark, sf)))


@plan("freshness_status", with_readings("""SELECT count(*) AS assets_tracked,
   coalesce(string_agg(asset, ',' ORDER BY asset) FILTER (old), '') AS degraded_assets,
   CASE WHEN count(*) = 0 THEN 'unhealthy' WHEN bool_or(old) THEN 'degraded' ELSE 'healthy' END AS status
   FROM (SELECT asset, (SELECT t FROM newest) - max(timestamp) > 120 AS old FROM readings GROUP BY 1)"""))
def freshness_status(spark, sf):
    df = readings(spark, sf)
    out = health.freshness_status(consensus.latest_per_asset(df), now=as_of(df))
    return out.withColumn("degraded_assets", F.array_join("degraded_assets", ","))


@plan("cost_daily", f"""WITH {CALLS_SQL} SELECT source, ts_ms // 86400000 AS day, count(*) AS calls,
   round(count(*) * CASE source WHEN 'band' THEN 1.5 WHEN 'redstone' THEN 0.25 ELSE 0 END / 1000, 6) AS cost_usd,
   round(CASE source WHEN 'reflector' THEN 0 ELSE count(*) / 100.0 END, 6) AS budget_used FROM calls GROUP BY 1, 2""")
def cost_daily(spark, sf):
    rates = spark.createDataFrame([("band", 1.5, 100), ("redstone", 0.25, 100), ("chainlink", 0.0, 100), ("reflector", 0.0, 0)],
                                  "source string, usd_per_1k double, daily_budget bigint")
    out = health.cost_daily(feed_calls(spark, sf), rates)
    return out.select("source", "day", "calls", F.round("cost_usd", 6).alias("cost_usd"), F.round("budget_used", 6).alias("budget_used"))


@plan("counters", f"WITH {REQUESTS_SQL} SELECT endpoint, method, CAST(status AS BIGINT) AS status, count(*) AS count FROM requests GROUP BY 1, 2, 3")
def counters(spark, sf):
    out = health.counters(requests(spark, sf), ["endpoint", "method", "status"])
    return out.withColumn("status", F.col("status").cast("bigint"))


@plan("counters_updates", with_readings("SELECT asset, source, count(*) AS count FROM readings GROUP BY 1, 2"))
def counters_updates(spark, sf):
    return health.counters(readings(spark, sf), ["asset", "source"])


_BOUNDS = "(0.001), (0.005), (0.01), (0.025), (0.05), (0.1), (0.25), (0.5), (1), (2.5), (5), (CAST('inf' AS DOUBLE))"
HIST_CTE = f"""{REQUESTS_SQL}, bounds(le) AS (VALUES {_BOUNDS}),
hist AS (SELECT endpoint, CAST(le AS DOUBLE) AS le, count(*) FILTER (latency_s <= le) AS count, count(*) AS total, sum(latency_s) AS s
         FROM requests, bounds GROUP BY 1, 2)"""


@plan("histogram_le", f"WITH {HIST_CTE} SELECT endpoint, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le, count, total, round(s, 4) AS sum FROM hist")
def histogram_le(spark, sf):
    out = health.histogram_le(requests(spark, sf), ["endpoint"], "latency_s", health.HTTP_LATENCY_BUCKETS)
    name = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    return out.select("endpoint", name.alias("le"), "count", "total", F.round("sum", 4).alias("sum"))


def _histogram(rows: str, keys: str, value: str, bounds) -> str:
    """All buckets of one value; `rows` names a relation."""
    listed = ", ".join(f"({b})" for b in bounds)
    return f"""SELECT {keys}, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le,
     count({value}) FILTER ({value} <= le) AS count, count({value}) AS total, round(sum({value}), 4) AS sum
   FROM {rows}, (SELECT CAST(b AS DOUBLE) AS le FROM (VALUES {listed}, (CAST('inf' AS DOUBLE))) t(b)) GROUP BY ALL"""


def histogram_out(out, *keys):
    name = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    return out.select(*keys, name.alias("le"), "count", "total", F.round("sum", 4).alias("sum"))


@plan("histogram_feed_latency", f"WITH {CALLS_SQL} " + _histogram(
    "(SELECT *, CASE WHEN ok THEN 'success' ELSE 'error' END AS status FROM calls)", "source, asset, status", "latency_s", health.FEED_LATENCY_BUCKETS))
def histogram_feed_latency(spark, sf):
    """Feed request times by source, asset and outcome."""
    calls = feed_calls(spark, sf).withColumn("status", F.when(F.col("ok"), "success").otherwise("error"))
    keys = ["source", "asset", "status"]
    return histogram_out(health.histogram_le(calls, keys, "latency_s", health.FEED_LATENCY_BUCKETS), *keys)


@plan("histogram_sessions", f"""WITH {REQUESTS_SQL}, gaps AS (SELECT *, timestamp - lag(timestamp) OVER w AS gap FROM requests
     WINDOW w AS (PARTITION BY api_key_prefix ORDER BY timestamp, seq)),
   marked AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY api_key_prefix ORDER BY timestamp, seq) AS session FROM gaps),
   sessions AS (SELECT api_key_prefix, (max(timestamp) - min(timestamp)) / 1000.0 AS seconds FROM marked GROUP BY api_key_prefix, session)
   """ + _histogram("(SELECT 'api' AS service, seconds FROM sessions)", "service", "seconds", health.SESSION_BUCKETS))
def histogram_sessions(spark, sf):
    """Lengths of connections: requests of a key with less than six hours between them."""
    rows = requests(spark, sf).select("api_key_prefix", F.timestamp_millis("timestamp").alias("at"))
    sessions = rows.groupBy("api_key_prefix", F.session_window("at", "21600001 milliseconds")).agg(
        (F.unix_millis(F.max("at")) - F.unix_millis(F.min("at"))).alias("ms"))
    lengths = sessions.select(F.lit("api").alias("service"), (F.col("ms") / 1000).alias("seconds"))
    return histogram_out(health.histogram_le(lengths, ["service"], "seconds", health.SESSION_BUCKETS), "service")


@plan("histogram_deviation", with_readings(_histogram("devs", "source, asset", "deviation", health.DEVIATION_BUCKETS), BREAKER_CTE))
def histogram_deviation(spark, sf):
    """Deviations from the cross-source median by source and asset."""
    keys = ["source", "asset"]
    return histogram_out(health.histogram_le(states(spark, sf), keys, "deviation", health.DEVIATION_BUCKETS), *keys)


@plan("histogram_quantile", f"""WITH {HIST_CTE}, p AS (SELECT *, coalesce(lag(count) OVER w, 0) AS prev, coalesce(lag(le) OVER w, 0) AS low,
     CAST(0.99 AS DOUBLE) * total AS r FROM hist WINDOW w AS (PARTITION BY endpoint ORDER BY le))
   SELECT endpoint, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * ((r - prev) / (count - prev)) END, 6) AS quantile
   FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY le) AS rn FROM p WHERE count >= r) WHERE rn = 1""")
def histogram_quantile(spark, sf):
    buckets = health.histogram_le(requests(spark, sf), ["endpoint"], "latency_s", health.HTTP_LATENCY_BUCKETS)
    out = health.histogram_quantile(buckets, ["endpoint"], 0.99)
    return out.select("endpoint", F.round("quantile", 6).alias("quantile"))


@plan("slo_report", with_readings("""SELECT slo, target, round(o, 6) AS observed_pct,
   CASE WHEN o IS NULL THEN 'UNKNOWN' WHEN o >= target THEN 'MET' ELSE 'BREACHED' END AS status
   FROM (VALUES ('api-availability', 99.9::DOUBLE), ('api-latency', 99.0), ('price-freshness', 99.5), ('unmeasured', 50.0)) t(slo, target)
   LEFT JOIN (SELECT slo, avg(r) * 100 AS o FROM (SELECT slo, ts // 300 AS p, avg(CASE WHEN good THEN 1.0 ELSE 0.0 END) AS r FROM ev GROUP BY 1, 2)
              GROUP BY 1) USING (slo)""", REQUESTS_SQL, SERIES_CTE, f"""ev AS (
     SELECT 'api-availability' AS slo, timestamp // 1000 AS ts, status < 500 AS good FROM requests
     UNION ALL SELECT 'api-latency', timestamp // 1000, latency_s <= 1 FROM requests
     UNION ALL SELECT 'price-freshness', tick * {POLL}, NOT stale FROM series)"""))
def slo_report(spark, sf):
    req, ser = requests(spark, sf), series(spark, sf)
    at = F.floor(F.col("timestamp") / 1000).alias("ts")
    events = (
        req.select(F.lit("api-availability").alias("slo"), at, (F.col("status") < 500).alias("good"))
        .unionByName(req.select(F.lit("api-latency").alias("slo"), at, (F.col("latency_s") <= 1).alias("good")))
        .unionByName(ser.select(F.lit("price-freshness").alias("slo"), (F.col("tick") * POLL).alias("ts"), (~F.col("stale")).alias("good")))
    )
    out = health.slo_report(events, objectives={**health.OBJECTIVES, "unmeasured": 50.0})
    return out.select("slo", "target", F.round("observed_pct", 6).alias("observed_pct"), "status")


@plan("uptime_pct", f"""WITH {CHECKS_SQL} SELECT component, floor(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) * 10000 + 0.5) / 100 AS uptime_pct
   FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY seq DESC) AS rn FROM checks WHERE kind = 'check') WHERE rn <= 1440 GROUP BY 1""")
def uptime_pct(spark, sf):
    return health.uptime_pct(checks(spark, sf))


@plan("overall_status", f"""WITH {CHECKS_SQL} SELECT CASE max(r) WHEN 2 THEN 'down' WHEN 1 THEN 'degraded' ELSE 'operational' END AS status
   FROM (SELECT component, arg_max(CASE WHEN kind = 'degraded' THEN 1 WHEN ok THEN 0 ELSE 2 END, seq) AS r FROM checks GROUP BY 1)""")
def overall_status(spark, sf):
    return health.overall_status(health.component_status(checks(spark, sf)))


INCIDENTS_CTE = f"""{CHECKS_SQL}, st AS (SELECT *, CASE WHEN kind = 'degraded' THEN 1 WHEN ok THEN 0 ELSE 2 END AS state FROM checks),
inc0 AS (SELECT *, coalesce(lag(state) OVER w, 0) AS was,
    (SELECT NULL) AS unused, first_value(CASE WHEN kind = 'check' AND ok THEN ts_ms END IGNORE NULLS)
      OVER (PARTITION BY component ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ok
  FROM st WINDOW w AS (PARTITION BY component ORDER BY seq)),
inc AS (SELECT 'INC-' || lpad(CAST(row_number() OVER (ORDER BY seq) AS VARCHAR), 4, '0') AS id, component, seq, ts_ms // 1000 AS started_at,
          next_ok // 1000 AS resolved_at, CASE WHEN next_ok IS NULL THEN 'investigating' ELSE 'resolved' END AS status
        FROM inc0 WHERE kind = 'check' AND NOT ok AND was = 0)"""


@plan("incidents", f"""WITH {INCIDENTS_CTE} SELECT id, component, status, started_at, resolved_at,
   CASE WHEN resolved_at IS NULL THEN 1 ELSE 2 END AS updates FROM inc""")
def incidents(spark, sf):
    out = health.incidents(checks(spark, sf))
    return out.select("id", "component", "status", "started_at", "resolved_at", F.size("updates").alias("updates"))


@plan("incident_list", f"WITH {INCIDENTS_CTE} SELECT id, component, started_at FROM inc ORDER BY seq DESC LIMIT 20")
def incident_list(spark, sf):
    return health.incident_list(health.incidents(checks(spark, sf))).select("id", "component", "started_at")


USAGE_CTE = f"""{REQUESTS_SQL}, hourly AS (
  SELECT timestamp // 3600000 * 3600000 AS hour, 'total' AS dimension, CAST(NULL AS VARCHAR) AS name, count(*) AS count FROM requests GROUP BY 1
  UNION ALL SELECT timestamp // 3600000 * 3600000, 'endpoint', method || ' ' || endpoint, count(*) FROM requests GROUP BY 1, 3
  UNION ALL SELECT timestamp // 3600000 * 3600000, 'key', api_key_prefix, count(*) FROM requests GROUP BY 1, 3
  UNION ALL SELECT timestamp // 3600000 * 3600000, 'asset', asset, count(*) FROM requests WHERE asset IS NOT NULL GROUP BY 1, 3),
now AS (SELECT max(timestamp) AS t FROM requests),
summed AS (SELECT dimension, name, CAST(sum(count) AS BIGINT) AS count FROM hourly
           WHERE hour >= (SELECT t FROM now) - CAST({{h}} AS BIGINT) * 3600000 GROUP BY 1, 2),
tops AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, name) AS rank FROM summed)"""


@plan("usage_hourly", f"WITH {USAGE_CTE.format(h=24)} SELECT hour, dimension, name, count FROM hourly")
def usage_hourly(spark, sf):
    return usage.usage_hourly(requests(spark, sf))


@plan("usage_report", f"WITH {USAGE_CTE.format(h=168)} SELECT dimension, name, count, rank, 'weekly' AS period FROM tops WHERE rank <= 10")
def usage_report(spark, sf):
    req = requests(spark, sf)
    return usage.usage_report(usage.usage_hourly(req), now_ms=as_of(req), period="weekly")


@plan("top_entries", f"WITH {USAGE_CTE.format(h=100000)} SELECT dimension, name, count, rank FROM tops WHERE rank <= 10")
def top_entries(spark, sf):
    hourly = usage.usage_hourly(requests(spark, sf))
    return usage.top_entries(hourly.groupBy("dimension", "name").agg(F.sum("count").alias("count")))


@plan("usage_anomalies", f"""WITH {USAGE_CTE.format(h=24)}, pts AS (SELECT hour, count, avg(count) OVER () AS m, stddev_pop(count) OVER () AS s
     FROM hourly WHERE dimension = 'total' AND hour >= (SELECT t FROM now) - CAST(720 AS BIGINT) * 3600000)
   SELECT hour, count, round(m, 2) AS mean, round(s, 2) AS std_dev, round((count - m) / s, 2) AS z_score FROM pts
   WHERE abs((count - m) / s) >= 2""")
def usage_anomalies(spark, sf):
    req = requests(spark, sf)
    return usage.usage_anomalies(usage.usage_total(req), now_ms=as_of(req), z_limit=2.0, lookback_h=720)


@plan("affected_consumers", f"WITH {REQUESTS_SQL} SELECT endpoint AS path, api_key_prefix, min(seq) AS first_seq FROM requests GROUP BY 1, 2")
def affected_consumers(spark, sf):
    return usage.affected_consumers(requests(spark, sf).withColumnRenamed("endpoint", "path"))
