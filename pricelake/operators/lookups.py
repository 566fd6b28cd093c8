"""Lookups and routing: batch prices, dimensions, subscriptions, webhooks, paging."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricelake.operators.chunks import CHUNK_ROWS, running
from pricelake.operators.validate import MAX_ASSETS

# Fixed values of the paging rules.
PAGE_SIZE, MAX_PAGE_SIZE = 50, 500
OFFSET_PAGE_SIZE, MAX_OFFSET_PAGE_SIZE = 20, 100


def batch_prices(latest: DataFrame, assets: list[str]) -> DataFrame:
    """Up to 50 assets looked up at once; unknown ones are marked NOT_FOUND."""
    if not 1 <= len(assets) <= MAX_ASSETS:
        raise ValueError(f"1 to {MAX_ASSETS} assets")
    wanted = latest.sparkSession.createDataFrame([(a.upper(),) for a in assets], "asset string")
    found = wanted.join(latest.filter(F.col("asset").isin([a.upper() for a in assets])), "asset", "left")
    return found.withColumn("error", F.when(F.col("timestamp").isNull(), "NOT_FOUND"))


def batch_summary(batch: DataFrame) -> DataFrame:
    return batch.agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col("error").isNull()).alias("found"))


def fk_dims(facts: DataFrame, assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with asset and source codes; only enabled dimension rows take part."""
    a = assets.filter("enabled").select(F.col("id").alias("asset_id"), F.col("code").alias("asset"))
    s = sources.filter("enabled").select(F.col("id").alias("source_id"), F.col("code").alias("source"))
    return facts.join(a, "asset_id").join(s, "source_id")


def fanout_subscriptions(updates: DataFrame, clients: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(update, client) deliveries: subscribers of the asset, and clients without
    any subscription for every update.

    Clients without subscriptions are expanded over the watched assets first, so
    one hash join on the asset serves both.
    """
    assets = updates.agg(F.array_sort(F.collect_set("asset"))).scalar()
    open_clients = clients.join(subscriptions, "client", "left_anti")
    routes = subscriptions.select("client", "asset").distinct().unionByName(
        open_clients.select("client", F.explode(assets).alias("asset")))
    return updates.join(routes, "asset")


def fanout_counts(updates: DataFrame, clients: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages per client, from per-asset counts instead of single deliveries."""
    per_asset = updates.groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    total = per_asset.agg(F.sum("n")).scalar()
    subscribed = subscriptions.select("client", "asset").distinct().join(per_asset, "asset", "left")
    counted = subscribed.groupBy("client").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))
    open_clients = clients.join(subscriptions, "client", "left_anti").select("client", total.alias("messages"))
    return counted.unionByName(open_clients)


def webhook_threshold(registrations: DataFrame, updates: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Updates that move an asset by at least a registration's percentage.

    The update before must already have been seen by the registration (the first
    one after its creation only primes it).
    """
    moves = running(updates, ["asset"], "seq", {
        "prev": ("last", F.col("price")), "prev_ms": ("last", F.col("ts_ms"))}, size, exclusive=["prev", "prev_ms"])
    now, before = F.col("price").cast("double"), F.col("prev").cast("double")
    pct = F.when(before != 0, F.abs((now - before) / before) * 100).when(now != 0, F.lit(float("inf")))
    moves = moves.withColumn("change_pct", pct)
    wanted = registrations.filter("type = 'threshold'")
    # The smallest threshold of an asset drops most updates before the join.
    least = wanted.groupBy("asset").agg(F.min("value").alias("__least"))
    moves = moves.join(least, "asset").filter(F.col("change_pct") >= F.col("__least")).drop("__least")
    hit = (F.col("change_pct") >= F.col("value")) & (F.col("prev_ms") >= F.col("created_ms"))
    return moves.join(wanted, "asset").filter(hit)


def encode_cursor(ts: int) -> str:
    text = json.dumps({"ts": ts, "dir": "asc"}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def cursor_text(ts: Column) -> Column:
    """`encode_cursor` as a column."""
    body = F.concat(F.lit('{"ts":'), ts.cast("string"), F.lit(',"dir":"asc"}'))
    return F.rtrim(F.translate(F.base64(F.encode(body, "UTF-8")), "+/=", "-_ "))


def decode_cursor(cursor: str | None) -> int | None:
    """Timestamp of a cursor; anything unreadable means: from the start."""
    try:
        raw = base64.urlsafe_b64decode((cursor or "") + "=" * (-len(cursor or "") % 4))
        parsed = json.loads(raw)
        ts = parsed["ts"]
        return int(ts) if parsed.get("dir") == "asc" and isinstance(ts, (int, float)) else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def history_range(
    history: DataFrame, asset: str, *, start: int | None = None, end: int | None = None, limit: int = 100,
    descending: bool = False,
) -> DataFrame:
    """The newest `limit` rows of [start, end], ascending unless asked otherwise."""
    rows = history.filter(F.col("asset") == asset)
    if start is not None:
        rows = rows.filter(F.col("timestamp") >= start)
    if end is not None:
        rows = rows.filter(F.col("timestamp") <= end)
    newest = rows.orderBy(F.col("timestamp").desc(), F.col("source").asc(), F.col("seq").desc()).limit(limit)
    if descending:
        return newest
    return newest.orderBy(F.col("timestamp").asc(), F.col("source").desc(), F.col("seq").asc())


def history_cursor(
    history: DataFrame, asset: str, *, cursor: str | None = None, after_source: str | None = None,
    limit: int = PAGE_SIZE, end: int | None = None,
) -> DataFrame:
    """The oldest `limit` rows after the cursor, ascending by (timestamp, source).

    With `after_source` the page starts inside the cursor's second, so rows of
    other sources at that time are not lost.
    """
    after = decode_cursor(cursor)
    rows = history.filter(F.col("asset") == asset)
    if after is not None:
        later = F.col("timestamp") > after
        if after_source is not None:
            later = later | ((F.col("timestamp") == after) & (F.col("source") > after_source))
        rows = rows.filter(later)
    if end is not None:
        rows = rows.filter(F.col("timestamp") <= end)
    return rows.orderBy("timestamp", "source", "seq").limit(min(limit, MAX_PAGE_SIZE))


def cursor_meta(page: DataFrame, limit: int) -> DataFrame:
    """count, has_next_page and next_cursor of one page (at most 500 rows)."""
    meta = page.agg(F.count(F.lit(1)).alias("count"), F.max("timestamp").alias("__last"))
    more = F.col("count") == limit
    return meta.select("count", more.alias("has_next_page"), F.when(more, cursor_text(F.col("__last"))).alias("next_cursor"))


def page_offset(
    df: DataFrame, order: list[str], bucket: Column, *, page: int = 1, limit: int = OFFSET_PAGE_SIZE
) -> tuple[DataFrame, DataFrame]:
    """One page of a total order, and its metadata.

    `bucket` must not decrease along the order. Counts per bucket tell where the
    page begins; only the buckets that it touches are ranked, so a far page does
    not move all earlier rows. Bounds are scalar subqueries: no job runs before the result is asked for.
    """
    limit = min(limit, MAX_OFFSET_PAGE_SIZE)
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / limit))
    meta = sizes.withColumns({"total_pages": pages}).withColumn("page", F.least(F.lit(page), F.col("total_pages")))
    start = meta.select((F.col("page") - 1) * limit).scalar()

    upto = running(counts, [], "__bucket", {"__end": ("sum", F.col("n"))}, 100_000)
    begin = F.col("__end") - F.col("n")
    hit = upto.filter((F.col("__end") > start) & (begin < start + limit))
    edge = hit.agg(F.min("__bucket").alias("low"), F.max("__bucket").alias("high"), F.min(begin).alias("skipped"))
    low, high, skipped = (edge.select(c).scalar() for c in ("low", "high", "skipped"))
    inside = rows.filter(F.col("__bucket").between(low, high))
    ranked = inside.withColumn("__rank", skipped + F.row_number().over(W.partitionBy().orderBy(*order)))
    shown = ranked.filter((F.col("__rank") > start) & (F.col("__rank") <= start + limit)).orderBy("__rank")
    names = ["page", "limit", "total", "total_pages", "has_next_page", "has_prev_page"]
    meta = meta.withColumns({
        "limit": F.lit(limit), "has_next_page": F.col("page") < F.col("total_pages"), "has_prev_page": F.col("page") > 1})
    return shown.drop("__bucket", "__rank"), meta.select(*[F.col(c).cast("bigint") if c in names[:4] else F.col(c) for c in names])


def delivery_log(log: DataFrame, webhook: str | None = None, limit: int = 2000) -> DataFrame:
    """Newest delivery attempts, of one webhook or all."""
    rows = log if webhook is None else log.filter(F.col("webhook_id") == webhook)
    return rows.orderBy(F.col("seq").desc()).limit(limit)


def delivery_summary(log: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Attempts, deliveries and exhausted series per webhook and attempt number."""
    return log.groupBy("webhook_id", "attempt").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("delivered"),
        F.count_if(~F.col("success") & (F.col("attempt") >= max_attempts)).alias("exhausted"))
