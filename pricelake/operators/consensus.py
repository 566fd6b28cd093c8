"""Consensus price per asset, at one moment or at every poll tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricelake.functions import decimals as D
from pricelake.operators.chunks import running, top_per_key
from pricelake.session import materialize
from pricelake.schemas import FEEDS, POLL_SECONDS, STALENESS_SECONDS

WIDE = D.WIDE


def _with_state(readings: DataFrame) -> DataFrame:
    """Readings with a `suspicious` flag (false unless breaker_state set one)."""
    if "suspicious" in readings.columns:
        return readings
    return readings.withColumn("suspicious", F.lit(False))


def newest_per_source(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Newest reading by (timestamp, seq) per key; hash aggregation throughout."""
    at = F.col("__at")
    return (
        _with_state(readings)
        .withColumn("__at", D.order_key(F.col("timestamp"), F.col("seq")))
        .groupBy(*keys)
        .agg(
            F.max_by("price", at).alias("price"),
            F.max_by("decimals", at).alias("decimals"),
            F.max_by("suspicious", at).alias("suspicious"),
            F.max("timestamp").alias("timestamp"),
            F.max_by("seq", at).alias("seq"),
        )
    )


def _members() -> Column:
    """One array element per source; its length is bounded by the feed list."""
    return F.collect_list(F.struct("source", "price", "decimals", "timestamp", "suspicious"))


def _level(used: Column, total: Column, stale: Column) -> Column:
    ratio = used / F.greatest(total, F.lit(1))
    return (
        F.when(stale | (used == 0) | (ratio < 0.5), "critical")
        .when(ratio < 1.0, "degraded")
        .otherwise("healthy")
    )


def _decide(grouped: DataFrame, active: Column, total: Column, stale: Column) -> DataFrame:
    """Turn arrays of active readings into the consensus columns."""
    grouped = grouped.withColumns({"__active": active, "__total": total, "stale": stale})
    trusted = F.filter("__active", lambda r: ~r["suspicious"])
    grouped = grouped.withColumn("__used", F.when(F.size(trusted) > 0, trusted).otherwise(F.col("__active")))
    scale = F.array_max(F.transform("__active", lambda r: r["decimals"]))
    grouped = grouped.withColumn("decimals", scale)
    prices = F.transform("__used", lambda r: D.rescale(r["price"], r["decimals"], F.col("decimals")))
    used = F.size("__used")
    return grouped.withColumns({
        "price": D.middle_of(prices),
        "sources": F.array_sort(F.array_distinct(F.transform("__used", lambda r: r["source"]))),
        "timestamp": F.array_max(F.transform("__used", lambda r: r["timestamp"])),
        "confidence": used / F.greatest(F.col("__total"), F.lit(1)),
        "level": _level(used, F.col("__total"), F.col("stale")),
    }).drop("__active", "__used", "__total", "__all")


def consensus_price(readings: DataFrame, *, as_of: Column, staleness: int = STALENESS_SECONDS) -> DataFrame:
    """Consensus per asset at `as_of` (seconds; a literal or a scalar subquery).

    Pass the output of `breaker_state` to leave suspicious sources out.
    """
    latest = newest_per_source(readings.filter(F.col("timestamp") <= as_of), ["asset", "source"])
    latest = latest.withColumn("__age_ok", as_of - F.col("timestamp") < staleness)
    grouped = latest.groupBy("asset").agg(
        _members().alias("__all"),
        F.collect_list(
            F.when(F.col("__age_ok"), F.struct("source", "price", "decimals", "timestamp", "suspicious"))
        ).alias("__valid"),
    )
    stale = F.size("__valid") == 0
    active = F.when(stale, F.col("__all")).otherwise(F.col("__valid"))
    return _decide(grouped, active, F.size("__all"), stale).drop("__valid")


def consensus_series(
    readings: DataFrame,
    *,
    last_tick: Column,
    staleness: int = STALENESS_SECONDS,
    poll: int = POLL_SECONDS,
    fill_stale: bool = True,
    chunk_ticks: int = 100_000,
) -> DataFrame:
    """Consensus per (asset, tick); tick n stands for the time n*poll.

    A reading is fresh on the ticks ceil(ts/poll) .. ceil((ts+staleness)/poll)-1,
    so every tick is computed on its own and an asset spreads over all tasks.
    Ticks without a fresh reading keep the last known set and `stale=true`.
    """
    ceil = lambda c: F.ceil(c / F.lit(poll)).cast("bigint")
    polled = readings.withColumn("tick", ceil(F.col("timestamp"))).filter(F.col("tick") <= last_tick)
    # The last reading per source and tick is read four times below: store it once.
    latest = materialize(newest_per_source(polled, ["asset", "source", "tick"]), "ticks")
    until = F.least(ceil(F.col("timestamp") + staleness) - 1, last_tick)
    spread = latest.withColumn("__tick", F.explode(F.sequence("tick", F.greatest(until, F.col("tick")))))
    spread = spread.withColumn("tick", F.col("__tick")).drop("__tick")
    # One exchange on (asset, tick) serves both groupings below.
    fresh = newest_per_source(spread.repartition("asset", "tick"), ["asset", "source", "tick"])

    firsts = latest.groupBy("asset", "source").agg(F.min("tick").alias("first_tick"))
    seen = firsts.groupBy("asset").agg(F.collect_list("first_tick").alias("__firsts"))
    grouped = fresh.groupBy("asset", "tick").agg(_members().alias("__all")).join(seen, "asset")
    total = F.size(F.filter("__firsts", lambda t: t <= F.col("tick")))
    out = _decide(grouped, F.col("__all"), total, F.lit(False)).drop("__firsts")
    columns = ["asset", "tick", "price", "decimals", "sources", "timestamp", "confidence", "level", "stale"]
    out = out.select(*columns)
    if not fill_stale:
        return out

    covered = spread.select("asset", "tick").distinct().select("asset", "tick", (F.lit(0) - F.col("tick")).alias("__back"))
    covered = running(
        covered, ["asset"], "__back", {"__next": ("max", F.col("__back"))}, size=chunk_ticks, exclusive=["__next"]
    )
    after = F.coalesce(F.lit(0) - F.col("__next"), last_tick + 1)
    gaps = covered.select("asset", "tick", (after - 1).alias("gap_end")).filter(F.col("gap_end") > F.col("tick"))
    # Gaps are few and feed two branches; most series have none at all.
    gaps = materialize(gaps, "gaps")
    if gaps.isEmpty():
        return out

    # Last known reading of every source at the tick before each gap.
    marks = gaps.join(firsts, "asset").filter(F.col("first_tick") <= F.col("tick"))
    known = latest.select(
        "asset", "source", (F.col("tick") * 2).alias("__pos"), "price", "decimals", "timestamp", "suspicious",
        F.lit(None).cast("bigint").alias("gap_end"), "tick",
    )
    marks = marks.select(
        "asset", "source", (F.col("tick") * 2 + 1).alias("__pos"),
        F.lit(None).cast(WIDE).alias("price"), F.lit(None).cast("int").alias("decimals"),
        F.lit(None).cast("bigint").alias("timestamp"), F.lit(None).cast("boolean").alias("suspicious"),
        "gap_end", "tick",
    )
    carried = running(
        known.unionByName(marks), ["asset", "source"], "__pos",
        {f"k_{c}": ("last", F.col(c)) for c in ("price", "decimals", "timestamp", "suspicious")},
        size=chunk_ticks,
    ).filter(F.col("gap_end").isNotNull())
    carried = carried.select(
        "asset", "source", "tick", "gap_end",
        *[F.col(f"k_{c}").alias(c) for c in ("price", "decimals", "timestamp", "suspicious")],
    )
    held = carried.groupBy("asset", "tick", "gap_end").agg(_members().alias("__all"))
    held = _decide(held, F.col("__all"), F.size("__all"), F.lit(True))
    block = 4096
    held = held.withColumn("__from", F.explode(F.sequence(F.col("tick") + 1, F.col("gap_end"), F.lit(block))))
    held = held.withColumn(
        "__tick", F.explode(F.sequence("__from", F.least(F.col("__from") + block - 1, F.col("gap_end"))))
    )
    return out.unionByName(held.withColumn("tick", F.col("__tick")).select(*columns))


#: Distinct values of one key that a single task ranks without narrowing first.
RANKED_ROWS = 2_000_000
#: The finest quantile sketch; a band of it holds too many rows only if most are few values.
MOST_BINS = 12_800


def exact_median(
    df: DataFrame, keys: list[str], value: str, *, ranked_rows: int = RANKED_ROWS, bins: int = 200
) -> DataFrame:
    """Exact median per key for groups of any size, with the row count.

    Equal values are counted map-side before anything is ranked. While the
    largest group is beyond `ranked_rows`, quantile sketches (merged
    map-side) give a narrow band that must contain the middle ranks; rows outside
    are only counted. A group whose band misses the middle keeps all of its rows,
    so the result is exact whatever the sketch returned. Rounds repeat, with a finer
    sketch if one did not help, until the largest rest can be ranked or is one value.
    """
    rows = df.select(*keys, F.col(value).cast(WIDE).alias("__v")).filter(F.col("__v").isNotNull())
    rows = rows.withColumn("__d", F.col("__v").cast("double"))
    target = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    target = target.withColumns({"__lo": F.floor((F.col("n") + 1) / 2), "__hi": F.floor(F.col("n") / 2) + 1})
    target = target.withColumn("__m", F.col("n"))
    largest, rounds = target.agg(F.max("n")).first()[0] or 0, 0
    while largest > ranked_rows and bins <= MOST_BINS:
        rounds += 1
        steps = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
        sketch = rows.groupBy(*keys).agg(F.percentile_approx("__d", steps, 20 * bins).alias("__q"))
        place = lambda rank: F.floor((F.col(rank) - 1) / F.col("__m") * bins).cast("int")
        band = target.join(sketch, keys).withColumns({
            "__from": F.element_at("__q", F.greatest(place("__lo") - 1, F.lit(0)) + 1),
            "__to": F.element_at("__q", F.least(place("__hi") + 3, F.lit(bins)) + 1),
        })
        band = band.select(*keys, "__from", "__to")
        tagged = rows.join(band, keys)
        inside = F.col("__d").between(F.col("__from"), F.col("__to"))
        counts = tagged.groupBy(*keys).agg(
            F.count_if(F.col("__d") < F.col("__from")).alias("__below"), F.count_if(inside).alias("__in")
        )
        fits = (F.col("__lo") > F.col("__below")) & (F.col("__hi") <= F.col("__below") + F.col("__in"))
        target = target.join(counts, keys).select(
            *keys, "n", fits.alias("__fits"),
            *[F.when(fits, F.col(c) - F.col("__below")).otherwise(F.col(c)).alias(c) for c in ("__lo", "__hi")],
            F.when(fits, F.col("__in")).otherwise(F.col("__m")).alias("__m"),
        )
        keep = target.select(*keys, "__fits")
        # Both are read again below and in the next round.
        rows = materialize(tagged.join(keep, keys).filter(~F.col("__fits") | inside).select(*keys, "__v", "__d"), "band")
        target = materialize(target.drop("__fits"), "middle-ranks")
        spread = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), (F.min("__v") < F.max("__v")).alias("mixed"))
        rest = spread.filter("mixed").agg(F.max("c")).first()[0] or 0
        if rest > largest // 2:
            bins *= 4
        largest = rest
    per_value = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*keys).orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    ranked = per_value.withColumn("__upto", upto)
    if rounds:
        ranked = ranked.join(target, keys)
    else:
        # Nothing was set aside: the group size comes from the same windows.
        ranked = ranked.withColumn("n", F.sum("__c").over(W.partitionBy(*keys)))
        ranked = ranked.withColumns({"__lo": F.floor((F.col("n") + 1) / 2), "__hi": F.floor(F.col("n") / 2) + 1})
    covers = lambda rank: (F.col(rank) <= F.col("__upto")) & (F.col(rank) > F.col("__upto") - F.col("__c"))
    picked = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max(F.when(covers("__lo"), F.col("__v"))).alias("__a"),
        F.max(F.when(covers("__hi"), F.col("__v"))).alias("__b"),
    )
    return picked.select(*keys, "n", F.col("__a").alias("low"), F.col("__b").alias("high"),
                         D.midpoint(F.col("__a"), F.col("__b")).alias("median"))


def median_sql(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """percentile_cont(0.5) per key as a double, from the exact middle values."""
    found = exact_median(df, keys, value)
    mean = (F.col("low").cast("double") + F.col("high").cast("double")) / 2
    return found.select(*keys, mean.alias("median"), F.col("n").alias("count"))


def source_participation(consensus: DataFrame, keys: list[str], feeds=FEEDS) -> DataFrame:
    """0/1 column per feed: whether it was used for the consensus."""
    return consensus.select(
        *keys, *[F.when(F.array_contains("sources", f), 1).otherwise(0).cast("bigint").alias(f) for f in feeds]
    )


def label_confidence(source_count: Column) -> Column:
    return F.when(source_count >= 3, "high").when(source_count >= 2, "medium").otherwise("low")


def latest_per_asset(readings: DataFrame, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Newest reading per asset; ties on time go to the first source name.

    Reduced per source first, so only (asset, source) pairs are ranked.
    """
    pairs = newest_per_source(readings, [*keys, "source"]).drop("suspicious")
    return top_per_key(pairs, list(keys), [F.col("timestamp").desc(), F.col("source").asc()], 1)


def latest_one(readings: DataFrame, asset: str) -> DataFrame:
    return (
        readings.filter(F.col("asset") == asset)
        .orderBy(F.col("timestamp").desc(), F.col("source").asc(), F.col("seq").desc())
        .limit(1)
    )


def distinct_assets(readings: DataFrame) -> DataFrame:
    return readings.select("asset").distinct()


def source_count(readings: DataFrame) -> DataFrame:
    """Distinct sources overall: two-step distinct, so no task sees all rows."""
    return readings.select("source").distinct().agg(F.count(F.lit(1)).alias("sources"))
