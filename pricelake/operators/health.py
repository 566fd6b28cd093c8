"""Source health, uptime, incidents, histograms and service-level objectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricelake.operators.chunks import CHUNK_ROWS, running, top_per_key
from pricelake.schemas import STALENESS_SECONDS

# Call SLA, unhealthy streak, kept checks, budgets, bucket bounds,
# objectives in percent.
SLA_SECONDS = 5.0
UNHEALTHY_STREAK = 3
UPTIME_CHECKS = 1440
DAILY_CALL_BUDGET = 10000
FEED_LATENCY_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1, 2, 5, 10, 30)
HTTP_LATENCY_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5)
SESSION_BUCKETS = (1, 5, 15, 30, 60, 120, 300, 600, 1800, 3600)
DEVIATION_BUCKETS = (1, 5, 10, 20, 30, 50, 100)
OBJECTIVES = {"api-availability": 99.9, "api-latency": 99.0, "price-freshness": 99.5}
# Texts of incidents.
INCIDENT_TITLE = " is unreachable"
INCIDENT_OPENED = "Incident opened — investigating."
INCIDENT_RESOLVED = "Service recovered. Incident resolved."


def _half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5))


def source_health(calls: DataFrame) -> DataFrame:
    """Counters per source; the failure streak is what came after the last success."""
    second = lambda c: F.floor(c / 1000)
    totals = calls.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(~F.col("ok")).alias("total_failures"),
        second(F.max(F.when(F.col("ok"), F.col("ts_ms")))).alias("last_success"),
        second(F.max(F.when(~F.col("ok"), F.col("ts_ms")))).alias("last_failure"),
        F.max(F.when(F.col("ok"), F.col("seq"))).alias("__ok_seq"),
    )
    after = calls.select("source", "seq").join(totals.select("source", "__ok_seq"), "source")
    after = after.filter(F.col("__ok_seq").isNull() | (F.col("seq") > F.col("__ok_seq")))
    streak = after.groupBy("source").agg(F.count(F.lit(1)).alias("consecutive_failures"))
    out = totals.join(streak, "source", "left").drop("__ok_seq").withColumn(
        "consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))
    share = 1 - F.col("total_failures") / F.greatest(F.col("total_requests"), F.lit(1))
    return out.withColumns({
        "uptime_pct": _half_up(share * 100),
        "healthy": F.col("consecutive_failures") < UNHEALTHY_STREAK,
    })


def sla_breaches(calls: DataFrame, limit_s: float = SLA_SECONDS) -> DataFrame:
    return calls.groupBy("source").agg(F.count_if(F.col("ok") & (F.col("latency_s") > limit_s)).alias("breaches"))


def fleet_status(health: DataFrame) -> DataFrame:
    every, some = F.coalesce(F.bool_and("healthy"), F.lit(True)), F.coalesce(F.bool_or("healthy"), F.lit(False))
    return health.agg(F.when(every, "healthy").when(some, "degraded").otherwise("unhealthy").alias("status"))


def freshness_status(latest: DataFrame, *, now: Column, limit_s: int = STALENESS_SECONDS) -> DataFrame:
    """Overall status over one row per asset, with the assets that are too old."""
    old = now - F.col("timestamp") > limit_s
    marked = latest.withColumn("__old", old)
    return marked.agg(
        F.count(F.lit(1)).alias("assets_tracked"),
        F.array_sort(F.collect_list(F.when(F.col("__old"), F.col("asset")))).alias("degraded_assets"),
    ).withColumn(
        "status",
        F.when(F.col("assets_tracked") == 0, "unhealthy")
        .when(F.size("degraded_assets") > 0, "degraded").otherwise("healthy"))


def cost_daily(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Calls, cost and budget use per source and UTC day.

    `rates`: source, usd_per_1k, daily_budget.
    """
    day = F.floor(F.col("ts_ms") / 86_400_000)
    counted = calls.groupBy(F.lower("source").alias("source"), day.alias("day")).agg(F.count(F.lit(1)).alias("calls"))
    out = counted.join(rates, "source", "left")
    budget = F.coalesce(F.col("daily_budget"), F.lit(0))
    return out.select(
        "source", "day", "calls",
        (F.col("calls") * F.coalesce(F.col("usd_per_1k"), F.lit(0.0)) / 1000).alias("cost_usd"),
        F.when(budget > 0, F.col("calls") / budget).otherwise(0.0).alias("budget_used"))


def counters(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def histogram_le(df: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative `le` buckets (the last is infinity) with sum and count."""
    sums = [F.count_if(F.col(value) <= b).alias(f"__b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*keys).agg(*sums, F.count(value).alias("total"), F.sum(value).alias("sum"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"__b{i}").alias("count")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("count")))
    long = wide.select(*keys, "sum", "total", F.explode(F.array(*cells)).alias("__c"))
    return long.select(*keys, F.col("__c.le").alias("le"), F.col("__c.count").alias("count"), "sum", "total")


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets by linear interpolation inside a bucket."""
    order = W.partitionBy(*keys).orderBy("le")
    b = buckets.withColumns({
        "__prev": F.coalesce(F.lag("count").over(order), F.lit(0)),
        "__low": F.coalesce(F.lag("le").over(order), F.lit(0.0)),
        "__want": F.lit(q) * F.col("total"),
    })
    hit = b.filter((F.col("count") >= F.col("__want")) & ((F.col("__prev") < F.col("__want")) | (F.col("__prev") == 0)))
    first = top_per_key(hit, keys, [F.col("le").asc()], 1)
    inside = (F.col("__want") - F.col("__prev")) / (F.col("count") - F.col("__prev"))
    open_end = F.col("le") == float("inf")
    value = F.when(open_end, F.col("__low")).otherwise(F.col("__low") + (F.col("le") - F.col("__low")) * inside)
    return first.filter(F.col("total") > 0).select(*keys, value.alias("quantile"))


def slo_points(events: DataFrame, *, bucket_s: int = 300) -> DataFrame:
    """Good/total ratio per SLO and five-minute point; `events`: slo, ts (s), good."""
    point = F.floor(F.col("ts") / bucket_s)
    return events.groupBy("slo", point.alias("point")).agg(F.avg(F.col("good").cast("double")).alias("ratio"))


def slo_report(events: DataFrame, *, objectives: dict[str, float] | None = None) -> DataFrame:
    """Observed percentage per objective: MET, BREACHED, or UNKNOWN without data."""
    rows = list((objectives or OBJECTIVES).items())
    targets = events.sparkSession.createDataFrame(rows, "slo string, target double")
    observed = slo_points(events).groupBy("slo").agg((F.avg("ratio") * 100).alias("observed_pct"))
    out = targets.join(observed, "slo", "left")
    return out.withColumn(
        "status", F.when(F.col("observed_pct").isNull(), "UNKNOWN")
        .when(F.col("observed_pct") >= F.col("target"), "MET").otherwise("BREACHED"))


def uptime_pct(checks: DataFrame, *, keep: int = UPTIME_CHECKS) -> DataFrame:
    """Share of successes in the newest checks of each component, two decimals; 100 without checks."""
    recent = top_per_key(checks.filter("kind = 'check'"), ["component"], [F.col("seq").desc()], keep)
    ok = recent.groupBy("component").agg(F.avg(F.col("ok").cast("double")).alias("__r"))
    every = checks.select("component").distinct().join(ok, "component", "left")
    return every.select(
        "component", F.coalesce(_half_up(F.col("__r") * 10000) / 100, F.lit(100.0)).alias("uptime_pct"))


def component_status(checks: DataFrame) -> DataFrame:
    last = checks.groupBy("component").agg(
        F.max_by(F.when(F.col("kind") == "degraded", 1).when(F.col("ok"), 0).otherwise(2), "seq").alias("rank"))
    return last.select("component", "rank", _rank_name(F.col("rank")).alias("status"))


def _rank_name(rank: Column) -> Column:
    return F.when(rank == 2, "down").when(rank == 1, "degraded").otherwise("operational")


def overall_status(status: DataFrame) -> DataFrame:
    """The worst component decides."""
    return status.agg(_rank_name(F.coalesce(F.max("rank"), F.lit(0))).alias("status"))


def incidents(checks: DataFrame, *, size: int = CHUNK_ROWS) -> DataFrame:
    """An incident opens when an operational component fails a check and is
    resolved by its next good check; ids follow the order of opening."""
    check = F.col("kind") == "check"
    state = F.when(~check, 1).when(F.col("ok"), 0).otherwise(2)
    rows = running(checks.select("seq", "component", "kind", "ok", "ts_ms"), ["component"], "seq", {
        "__was": ("last", state), "__next_ok": ("next", F.when(check & F.col("ok"), F.col("ts_ms")))},
        size, exclusive=["__was", "__next_ok"], shared=True)
    opened = rows.filter(check & ~F.col("ok") & (F.coalesce("__was", F.lit(0)) == 0))
    opened = opened.select("seq", "component", "ts_ms", "__next_ok")
    opened = running(opened, [], "seq", {"number": ("sum", F.lit(1))}, size, shared=True)
    second = lambda c: F.floor(F.col(c) / 1000).alias
    done = F.col("__next_ok").isNotNull()
    opening = F.struct(F.lit(INCIDENT_OPENED).alias("message"),
                       F.floor(F.col("ts_ms") / 1000).alias("timestamp"))
    closing = F.struct(F.lit(INCIDENT_RESOLVED).alias("message"),
                       F.floor(F.col("__next_ok") / 1000).alias("timestamp"))
    number = F.col("number").cast("string")
    return opened.select(
        F.concat(F.lit("INC-"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)).alias("id"),
        F.concat("component", F.lit(INCIDENT_TITLE)).alias("title"), "component", "seq",
        F.when(done, "resolved").otherwise("investigating").alias("status"), F.lit("major").alias("severity"),
        second("ts_ms")("started_at"), second("__next_ok")("resolved_at"),
        F.when(done, F.array(opening, closing)).otherwise(F.array(opening)).alias("updates"))


def incident_list(found: DataFrame, limit: int = 20) -> DataFrame:
    """The newest incidents."""
    return found.orderBy(F.col("seq").desc()).limit(limit)
