"""Consensus, medians, latest prices and the deviation breaker."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelake.functions import decimals as D
from pricelake.operators import breaker, consensus
from pricelake.plans.inputs import STALE, as_of, line_readings, LINES_SQL, order_readings, ORDERS_SQL, readings, with_readings
from pricelake.plans.registry import plan
from pricelake.schemas import FEEDS

POLL = 3600
LIMIT = 90.0

_MID = "CAST(CAST({l}[(len({l})+1)//2] + {l}[len({l})//2+1] AS DECIMAL(30,0)) * 0.5 AS DECIMAL(32,1))"


def mid(name: str) -> str:
    return _MID.format(l=name)


def consensus_out(df, *keys):
    return df.select(
        *keys, F.col("price").cast("string").alias("price"), F.col("decimals").cast("bigint").alias("decimals"),
        F.array_join("sources", ",").alias("sources"), F.col("timestamp").cast("bigint").alias("timestamp"),
        F.round("confidence", 6).alias("confidence"), "level", "stale",
    )


_LEVEL = """CASE WHEN stale OR used / CAST(total AS DOUBLE) < 0.5 THEN 'critical'
                 WHEN used < total THEN 'degraded' ELSE 'healthy' END"""


def _consensus_sql(source_cte: str, flag: str) -> str:
    return f"""
    , lastp AS (SELECT asset, source, arg_max(price, seq) AS price, max(timestamp) AS ts,
                       arg_max({flag}, seq) AS susp FROM {source_cte} GROUP BY 1, 2),
    marked AS (SELECT l.*, (SELECT t FROM newest) - ts < {STALE} AS fresh FROM lastp l),
    tot AS (SELECT asset, count(*) AS total, bool_or(fresh) AS any_fresh,
                   bool_or(NOT susp AND fresh) AS any_trust, bool_or(NOT susp) AS any_trust_all FROM marked GROUP BY 1),
    used AS (SELECT m.*, total, NOT any_fresh AS stale FROM marked m JOIN tot USING (asset)
             WHERE (fresh OR NOT any_fresh)
               AND (NOT susp OR NOT (CASE WHEN any_fresh THEN any_trust ELSE any_trust_all END))),
    g AS (SELECT asset, list_sort(list(price)) AS l, string_agg(source, ',' ORDER BY source) AS sources,
                 max(ts) AS timestamp, count(*) AS used, max(total) AS total, bool_or(stale) AS stale
          FROM used GROUP BY 1)
    SELECT asset, CAST({mid('l')} AS VARCHAR) AS price, CAST(8 AS BIGINT) AS decimals, sources, timestamp,
           round(used / CAST(total AS DOUBLE), 6) AS confidence, {_LEVEL} AS level, stale FROM g"""


@plan("consensus_price", with_readings("", "dummy AS (SELECT 1)").rstrip() + _consensus_sql("readings", "false"))
def consensus_price(spark, sf):
    df = readings(spark, sf)
    return consensus_out(consensus.consensus_price(df, as_of=as_of(df), staleness=STALE), "asset")


BREAKER_CTE = f"""asofs AS (
  SELECT *, """ + ", ".join(
    f"last_value(CASE WHEN source = '{s}' THEN price END IGNORE NULLS) OVER w AS p_{s}"
    for s in ("chainlink", "redstone", "band", "reflector")
) + f""" FROM readings WINDOW w AS (PARTITION BY asset ORDER BY seq ROWS UNBOUNDED PRECEDING)),
lists AS (SELECT *, list_sort(list_filter([p_chainlink, p_redstone, p_band, p_reflector], lambda x: x IS NOT NULL)) AS l
          FROM asofs),
meds AS (SELECT *, {mid('l')} AS median FROM lists),
devs AS (SELECT *, CASE WHEN median = 0 THEN 0 ELSE
           abs(CAST(price AS DOUBLE) - CAST(median AS DOUBLE)) / CAST(median AS DOUBLE) * 100 END AS deviation FROM meds),
flags AS (SELECT *, deviation > {LIMIT} AS is_dev, row_number() OVER (PARTITION BY asset, source ORDER BY seq) AS n FROM devs),
runs AS (SELECT *, max(CASE WHEN is_dev THEN n END) OVER w AS dev_n,
           sum(CASE WHEN is_dev THEN 1 ELSE 0 END) OVER w AS deviations,
           max(CASE WHEN is_dev THEN timestamp END) OVER w AS last_suspicion
         FROM flags WINDOW w AS (PARTITION BY asset, source ORDER BY seq ROWS UNBOUNDED PRECEDING)),
states AS (SELECT *, coalesce(n - dev_n < 3, false) AS suspicious,
                  CASE WHEN coalesce(n - dev_n < 3, false) THEN n - dev_n ELSE 0 END AS successes FROM runs)"""


def states(spark, sf):
    return breaker.breaker_state(readings(spark, sf), limit_pct=LIMIT, scale=8)


@plan("asof_latest_by_source", with_readings("""SELECT seq, asset, source,
   CAST(p_chainlink AS VARCHAR) AS p_chainlink, CAST(p_redstone AS VARCHAR) AS p_redstone,
   CAST(p_band AS VARCHAR) AS p_band, CAST(p_reflector AS VARCHAR) AS p_reflector FROM asofs""", BREAKER_CTE))
def asof_latest_by_source(spark, sf):
    df = breaker.asof_latest_by_source(readings(spark, sf), feeds=FEEDS, scale=8)
    return df.select("seq", "asset", "source", *[F.col(f"price_{f}").cast("string").alias(f"p_{f}") for f in FEEDS])


@plan("breaker_state", with_readings("""SELECT seq, asset, source, CAST(median AS VARCHAR) AS median,
   round(deviation, 6) AS deviation, suspicious, CAST(deviations AS BIGINT) AS deviations, last_suspicion,
   CAST(successes AS BIGINT) AS consecutive_successes FROM states""", BREAKER_CTE))
def breaker_state(spark, sf):
    return states(spark, sf).select(
        "seq", "asset", "source", F.col("median").cast("string").alias("median"),
        F.round("deviation", 6).alias("deviation"), "suspicious", "deviations", "last_suspicion",
        "consecutive_successes",
    )


@plan("consensus_trusted", with_readings("", BREAKER_CTE).rstrip() + _consensus_sql("states", "suspicious"))
def consensus_trusted(spark, sf):
    df = states(spark, sf)
    now = as_of(readings(spark, sf))
    return consensus_out(consensus.consensus_price(df, as_of=now, staleness=STALE), "asset")


@plan("breaker_metrics", with_readings("""SELECT count(*) AS total_sources,
   CAST(count(*) FILTER (s) AS BIGINT) AS suspicious_sources,
   coalesce(string_agg(asset || ':' || source || '=' || CAST(d AS VARCHAR), ',' ORDER BY asset || ':' || source) FILTER (s), '')
     AS suspicious_list FROM lasts""", BREAKER_CTE,
    "lasts AS (SELECT asset, source, arg_max(suspicious, seq) AS s, CAST(arg_max(deviations, seq) AS BIGINT) AS d "
    "FROM states GROUP BY 1, 2)"))
def breaker_metrics(spark, sf):
    items = F.transform("suspicious_list", lambda e: F.concat(e["key"], F.lit("="), e["deviations"].cast("string")))
    return breaker.breaker_metrics(states(spark, sf)).select(
        "total_sources", "suspicious_sources", F.array_join(items, ",").alias("suspicious_list"))


@plan("trailing_medians", with_readings("""SELECT seq, asset, array_to_string(
    list_transform(list(median) OVER (PARTITION BY asset ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
                   lambda m: CAST(m AS VARCHAR)), ',') AS trail FROM meds""", BREAKER_CTE))
def trailing_medians(spark, sf):
    out = breaker.trailing_medians(states(spark, sf))
    text = F.transform("trail", lambda m: m.cast("string"))
    return out.select("seq", "asset", F.array_join(text, ",").alias("trail"))


# Brute-force series: every tick looks up the newest reading of every source.
SERIES_CTE = f"""bounds AS (SELECT CAST(ceil(max(timestamp) / {POLL}.0) AS BIGINT) AS last FROM readings),
firsts AS (SELECT asset, source, min(CAST(ceil(timestamp / {POLL}.0) AS BIGINT)) AS first_tick FROM readings GROUP BY 1, 2),
ticks AS (SELECT a.asset, CAST(unnest(range(a.f, (SELECT last FROM bounds) + 1)) AS BIGINT) AS tick
          FROM (SELECT asset, min(first_tick) AS f FROM firsts GROUP BY 1) a),
cand AS (SELECT t.asset, t.tick, f.source, t.tick * {POLL} AS now FROM ticks t JOIN firsts f
         ON f.asset = t.asset AND f.first_tick <= t.tick),
uniq AS (SELECT asset, source, timestamp, arg_max(price, seq) AS price FROM readings GROUP BY 1, 2, 3),
known AS (SELECT c.asset, c.tick, c.source, c.now, r.price, r.timestamp AS ts FROM cand c ASOF JOIN uniq r
          ON r.asset = c.asset AND r.source = c.source AND r.timestamp <= c.now),
mark AS (SELECT *, now - ts < {STALE} AS fresh, bool_or(now - ts < {STALE}) OVER (PARTITION BY asset, tick) AS any_fresh,
                count(*) OVER (PARTITION BY asset, tick) AS total FROM known),
gs AS (SELECT asset, tick, list_sort(list(price)) AS l, string_agg(source, ',' ORDER BY source) AS sources,
             max(ts) AS timestamp, count(*) AS used, max(total) AS total, NOT bool_or(any_fresh) AS stale
      FROM mark WHERE fresh OR NOT any_fresh GROUP BY 1, 2),
series AS (SELECT asset, tick, {mid('l')} AS price, sources, timestamp, used, total, stale,
           round(used / CAST(total AS DOUBLE), 6) AS confidence, {_LEVEL} AS level FROM gs)"""


def series(spark, sf, staleness: int = STALE):
    df = readings(spark, sf)
    last = F.ceil(as_of(df) / F.lit(POLL)).cast("bigint")
    return consensus.consensus_series(df, last_tick=last, staleness=staleness, poll=POLL)


@plan("consensus_series", with_readings("""SELECT asset, tick, CAST(price AS VARCHAR) AS price,
   CAST(8 AS BIGINT) AS decimals, sources, timestamp, confidence, level, stale FROM series""", SERIES_CTE))
def consensus_series(spark, sf):
    return consensus_out(series(spark, sf), "asset", "tick")


@plan("consensus_series_sparse", with_readings("""SELECT asset, tick, CAST(price AS VARCHAR) AS price,
   CAST(8 AS BIGINT) AS decimals, sources, timestamp, confidence, level, stale FROM series""",
   SERIES_CTE.replace(f"< {STALE}", "< 3600")))
def consensus_series_sparse(spark, sf):
    """A short staleness limit, so that many ticks repeat the last known set."""
    return consensus_out(series(spark, sf, staleness=3600), "asset", "tick")


_MEDIAN = """SELECT {k}, CAST(CAST(l[(len(l)+1)//2] + l[len(l)//2+1] AS DECIMAL(30,0)) * 0.5 AS DECIMAL(32,1)) AS median,
             len(l) AS n FROM (SELECT {k}, list_sort(list(price)) AS l FROM readings GROUP BY 1)"""


@plan("exact_median", f"WITH {LINES_SQL}, m AS ({_MEDIAN.format(k='asset')}) "
      "SELECT asset, CAST(median AS VARCHAR) AS median, CAST(n AS BIGINT) AS n FROM m")
def exact_median(spark, sf):
    out = consensus.exact_median(line_readings(spark, sf), ["asset"], "price")
    return out.select("asset", F.col("median").cast("string").alias("median"), "n")


@plan("median_sql", with_readings("""SELECT asset, percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(price AS DOUBLE)) AS median,
      count(*) AS count FROM readings GROUP BY 1"""))
def median_sql(spark, sf):
    return consensus.median_sql(readings(spark, sf), ["asset"], "price")


_LATEST = """SELECT asset, source, CAST(price AS VARCHAR) AS price, timestamp, seq FROM (SELECT *, row_number() OVER
   (PARTITION BY asset ORDER BY timestamp DESC, source, seq DESC) AS rn FROM readings) WHERE rn = 1"""


@plan("latest_per_asset", with_readings(_LATEST))
def latest_per_asset(spark, sf):
    out = consensus.latest_per_asset(readings(spark, sf))
    return out.select("asset", "source", F.col("price").cast("string").alias("price"), "timestamp", "seq")


@plan("latest_per_asset_orders", f"WITH {ORDERS_SQL} {_LATEST}")
def latest_per_asset_orders(spark, sf):
    out = consensus.latest_per_asset(order_readings(spark, sf))
    return out.select("asset", "source", F.col("price").cast("string").alias("price"), "timestamp", "seq")


@plan("latest_one", with_readings("""SELECT asset, source, CAST(price AS VARCHAR) AS price, timestamp FROM readings
   WHERE asset = 'BTC' ORDER BY timestamp DESC, source, seq DESC LIMIT 1"""))
def latest_one(spark, sf):
    out = consensus.latest_one(readings(spark, sf), "BTC")
    return out.select("asset", "source", F.col("price").cast("string").alias("price"), "timestamp")


@plan("distinct_assets", with_readings("SELECT DISTINCT asset FROM readings"))
def distinct_assets(spark, sf):
    return consensus.distinct_assets(readings(spark, sf))


@plan("source_count", with_readings("SELECT count(DISTINCT source) AS sources FROM readings"))
def source_count(spark, sf):
    return consensus.source_count(readings(spark, sf))


@plan("source_participation", with_readings("SELECT asset, tick, " + ", ".join(
    f"CAST(contains(',' || sources || ',', ',{s},') AS BIGINT) AS {s}"
    for s in ("chainlink", "redstone", "band", "reflector")) + " FROM series", SERIES_CTE))
def source_participation(spark, sf):
    return consensus.source_participation(series(spark, sf), ["asset", "tick"])


@plan("label_confidence", with_readings("""SELECT asset, tick, CASE WHEN used >= 3 THEN 'high' WHEN used = 2 THEN 'medium'
   ELSE 'low' END AS label FROM series""", SERIES_CTE))
def label_confidence(spark, sf):
    return series(spark, sf).select("asset", "tick", consensus.label_confidence(F.size("sources")).alias("label"))


@plan("rescale_price", with_readings("""SELECT seq, CAST(price * 10000 AS VARCHAR) AS up,
   CAST(CAST(floor(CAST(price AS DOUBLE) / 1000000 + 0.5) AS BIGINT) AS VARCHAR) AS down FROM readings"""))
def rescale_price(spark, sf):
    return readings(spark, sf).select(
        "seq", D.rescale(F.col("price"), F.col("decimals"), F.lit(12)).cast("string").alias("up"),
        D.rescale(F.col("price"), F.col("decimals"), F.lit(2)).cast("string").alias("down"))


@plan("to_float_price", with_readings("SELECT seq, round(CAST(price AS DOUBLE) / 100000000.0, 6) AS price FROM readings"))
def to_float_price(spark, sf):
    return readings(spark, sf).select("seq", F.round(D.as_float(F.col("price"), F.col("decimals")), 6).alias("price"))


@plan("deviation_pct", with_readings("SELECT seq, round(deviation, 6) AS deviation FROM devs", BREAKER_CTE))
def deviation_pct(spark, sf):
    return states(spark, sf).select("seq", F.round("deviation", 6).alias("deviation"))


@plan("deviation_bps", with_readings("""SELECT seq, asset, CASE WHEN prev <> 0 THEN
   CAST((abs(price - prev) * 10000) // abs(prev) AS BIGINT) END AS bps, coalesce(prev <> 0 AND
   (abs(price - prev) * 10000) // abs(prev) > 2000, CASE WHEN prev = 0 THEN false END) AS exceeds
   FROM (SELECT seq, asset, CAST(price AS HUGEINT) AS price,
                CAST(lag(price) OVER (PARTITION BY asset ORDER BY seq) AS HUGEINT) AS prev FROM readings)"""))
def deviation_bps(spark, sf):
    from pricelake.operators.ledger import with_previous

    df = with_previous(readings(spark, sf), ["asset"], "seq", "price")
    return df.select("seq", "asset", D.deviation_bps(F.col("price"), F.col("prev")).cast("bigint").alias("bps"),
                     D.deviation_exceeds(F.col("price"), F.col("prev"), 2000).alias("exceeds"))
