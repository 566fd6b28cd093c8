"""Alert rows from consensus prices and per-poll source prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricelake.functions import decimals as D
from pricelake.operators.chunks import CHUNK_ROWS, running
from pricelake.operators.consensus import newest_per_source
from pricelake.operators.ledger import with_previous
from pricelake.schemas import POLL_SECONDS

# Fixed value: allowed spread between sources in percent.
DISAGREEMENT_PCT = 5.0
# Texts of alerts, for the batch and the stream.
DEVIATION_TEXT = "Price deviation alert for {asset}: {pct}% change"
STALE_TEXT = "Price data stale for {asset}: {age}s old (threshold: {limit}s)"
SOURCE_DOWN_TEXT = "All sources down for {asset} ({streak} consecutive failures)"
DISAGREEMENT_TEXT = "Source disagreement for {asset}: {pct}% spread across sources"


def filled(text: str, **values: Column) -> Column:
    """A text with columns in its places; doubles with two digits."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.format_string("%.2f", value) if name == "pct" else value.cast("string"))
    return out


def _alert(df: DataFrame, kind: str, message: Column, at: Column, **extra: Column) -> DataFrame:
    empty = {
        "previous_price": F.lit(None).cast("string"),
        "current_price": F.lit(None).cast("string"),
        "deviation_percent": F.lit(None).cast("double"),
        "affected_sources": F.lit(None).cast("array<string>"),
    }
    columns = {**empty, **extra}
    return df.select(
        at.alias("timestamp"), "asset", F.lit(kind).alias("type"), message.alias("message"),
        *[value.alias(name) for name, value in columns.items()])


def join_thresholds(consensus: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Only assets with configured thresholds are checked."""
    return consensus.join(thresholds, "asset")


def alert_deviation(
    consensus: DataFrame, thresholds: DataFrame, *, poll: int = POLL_SECONDS, size: int = CHUNK_ROWS
) -> DataFrame:
    """Price moved more than the threshold since the previous tick."""
    seen = join_thresholds(with_previous(consensus, ["asset"], "tick", "price", size), thresholds)
    now, before = F.col("price").cast("double"), F.col("prev").cast("double")
    moved = F.when(before != 0, F.abs((now - before) / before) * 100).when(
        before.isNotNull() & (now != 0), F.lit(float("inf")))
    seen = seen.withColumn("__moved", moved)
    hit = seen.filter((F.col("deviation_pct") > 0) & (F.col("__moved") > F.col("deviation_pct")))
    text = filled(DEVIATION_TEXT, asset=F.col("asset"), pct=F.col("__moved"))
    return _alert(
        hit, "deviation", text, F.col("tick") * poll, previous_price=F.col("prev").cast("string"),
        current_price=F.col("price").cast("string"), deviation_percent=F.col("__moved"))


def alert_stale(consensus: DataFrame, thresholds: DataFrame, *, poll: int = POLL_SECONDS) -> DataFrame:
    """Newest observation older than the threshold at the tick."""
    seen = join_thresholds(consensus, thresholds)
    seen = seen.withColumn("__age", F.col("tick") * poll - F.col("timestamp"))
    hit = seen.filter((F.col("stale_s") > 0) & (F.col("__age") > F.col("stale_s")))
    text = filled(STALE_TEXT, asset=F.col("asset"), age=F.col("__age"), limit=F.col("stale_s").cast("bigint"))
    return _alert(hit, "stale", text, F.col("tick") * poll)


def alert_source_down(
    consensus: DataFrame, thresholds: DataFrame, *, poll: int = POLL_SECONDS, size: int = CHUNK_ROWS
) -> DataFrame:
    """No valid source at this tick, after at least `source_down` such ticks in a row.

    The series has a row for every tick, so the streak before a tick follows
    from the last tick that had a source.
    """
    ok = ~F.col("stale")
    marked = running(
        consensus, ["asset"], "tick",
        {"__ok": ("max", F.when(ok, F.col("tick"))), "__first": ("min", F.col("tick"))}, size)
    streak = F.col("tick") - F.coalesce(F.col("__ok") + 1, F.col("__first"))
    seen = join_thresholds(marked.withColumn("streak", streak), thresholds)
    hit = seen.filter(F.col("stale") & (F.col("source_down") > 0) & (F.col("streak") >= F.col("source_down")))
    text = filled(SOURCE_DOWN_TEXT, asset=F.col("asset"), streak=F.col("streak"))
    return _alert(hit, "source_down", text, F.col("tick") * poll)


def alert_disagreement(
    readings: DataFrame, *, limit_pct: float = DISAGREEMENT_PCT, poll: int = POLL_SECONDS
) -> DataFrame:
    """Spread between the sources of one asset inside one poll."""
    polled = readings.withColumn("tick", F.ceil(F.col("timestamp") / F.lit(poll)).cast("bigint"))
    latest = newest_per_source(polled, ["asset", "source", "tick"])
    latest = latest.withColumn("__v", D.as_float(F.col("price"), F.col("decimals")))
    spread = latest.groupBy("asset", "tick").agg(
        F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.count("__v").alias("__n"),
        F.array_sort(F.collect_list("source")).alias("__sources"))
    spread = spread.withColumn(
        "__pct", F.when(F.col("__min") > 0, (F.col("__max") - F.col("__min")) / F.col("__min") * 100))
    hit = spread.filter((F.col("__n") >= 2) & (F.col("__pct") > limit_pct))
    text = filled(DISAGREEMENT_TEXT, asset=F.col("asset"), pct=F.col("__pct"))
    return _alert(hit, "deviation", text, F.col("tick") * poll, deviation_percent=F.col("__pct"),
                  affected_sources=F.col("__sources"))


CHANNELS = ("chat", "pager", "email", "webhook")


def alert_body(alerts: DataFrame) -> Column:
    """The whole alert as a struct with the names of the outgoing format; fields that a kind lacks are left out as nulls."""
    names = {"previous_price": "previousPrice", "current_price": "currentPrice", "deviation_percent": "deviationPercent",
             "affected_sources": "affectedSources"}
    return F.struct("timestamp", "asset", "type", "message", *[F.col(c).alias(to) for c, to in names.items()])


def alert_route(
    alerts: DataFrame, channels: tuple[str, ...] = CHANNELS, *, recipients: tuple[str, ...] = (), origin: str = "pricelake"
) -> DataFrame:
    """One row per alert and channel with severity, dedup key and the request body of the channel.

    The pager's routing key is a secret and is added by the sender.
    """
    channel = F.explode(F.array(*[F.lit(c) for c in channels]))
    severity = F.when(F.col("type") == "source_down", "critical").otherwise("warning")
    out = alerts.withColumns({"severity": severity, "dedup_key": F.concat_ws(":", "asset", "type"), "channel": channel})
    body = alert_body(alerts)
    chat = F.struct(F.concat(F.lit(":rotating_light: *"), F.upper("type"), F.lit("* — "), F.col("message")).alias("text"))
    pager = F.struct(
        F.lit("trigger").alias("event_action"), F.col("dedup_key"), F.struct(
            F.col("message").alias("summary"), F.lit(origin).alias("source"), F.col("severity"),
            body.alias("custom_details")).alias("payload"))
    email = F.struct(
        F.array(*[F.lit(r) for r in recipients]).cast("array<string>").alias("to"),
        F.concat(F.lit("[Price Alert] "), "type", F.lit(" for "), "asset").alias("subject"), F.col("message").alias("text"))
    made = {"chat": chat, "pager": pager, "email": email, "webhook": body}
    payload = F.lit(None).cast("string")
    for name, value in made.items():
        payload = F.when(F.col("channel") == name, F.to_json(value)).otherwise(payload)
    return out.withColumn("payload", payload)


def alert_history(alerts: DataFrame, limit: int = 100) -> DataFrame:
    """The newest alerts."""
    return alerts.orderBy(F.col("timestamp").desc(), "asset", "type", "message").limit(limit)
