"""Deviation breaker per (asset, source) and its as-of inputs."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from pricelake.functions import decimals as D
from pricelake.operators.chunks import CHUNK, CHUNK_ROWS, add_chunk, drop_halo, running, with_halo
from pricelake.schemas import FEEDS

# Deviation limit in percent, good readings needed to recover,
# medians kept per asset.
DEVIATION_LIMIT_PCT = 20.0
RECOVERY_SUCCESSES = 3
MEDIAN_HISTORY = 10


def asof_latest_by_source(
    readings: DataFrame, *, feeds: Sequence[str] = FEEDS, scale: int = 18, size: int = CHUNK_ROWS
) -> DataFrame:
    """Each reading with the newest arrival of every given feed of its asset so far.

    Adds `price_<feed>` columns (at `scale` decimals) and the array `current`: a column a feed,
    so for a short list of feeds. `running_median` is the form for all sources of the data.
    """
    scaled = readings.withColumn("__p", D.rescale(F.col("price"), F.col("decimals"), F.lit(scale)))
    values = {f"price_{f}": ("last", F.when(F.col("source") == f, F.col("__p"))) for f in feeds}
    out = running(scaled, ["asset"], "seq", values, size)
    current = F.filter(F.array(*[F.col(f"price_{f}") for f in feeds]), lambda p: p.isNotNull())
    return out.withColumns({"current": current, "scaled_price": F.col("__p")}).drop("__p")


def _entries(rows: DataFrame) -> DataFrame:
    """(asset, chunk, source, value): the last price of every source before each chunk of its asset.

    A price stands for the chunks up to and with the next one that has the source, so there is one row a
    chunk and source; chunks are numbered first, since their ids may have gaps.
    """
    lasts = rows.groupBy("asset", CHUNK, "source").agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("seq"))).alias("value"))
    # Every chunk has a row of some source, so the chunks can be told from these.
    chunks = W.partitionBy("asset")
    lasts = lasts.withColumn("__no", F.dense_rank().over(chunks.orderBy(CHUNK)))
    lasts = lasts.withColumn("__all", F.max("__no").over(chunks))
    known = lasts.filter(F.col("value").isNotNull())
    upto = F.coalesce(F.lead("__no").over(W.partitionBy("asset", "source").orderBy("__no")), F.col("__all"))
    held = known.withColumn("__upto", upto).filter(F.col("__upto") > F.col("__no"))
    held = held.select("asset", "source", "value", F.explode(F.sequence(F.col("__no") + 1, F.col("__upto"))).alias("__no"))
    return held.join(lasts.select("asset", CHUNK, "__no").distinct(), ["asset", "__no"]).select("asset", CHUNK, "source", "value")


def running_median(readings: DataFrame, *, scale: int = 18, size: int = CHUNK_ROWS) -> DataFrame:
    """Each reading with `scaled_price` and `median`: that of the newest arrivals of all sources of its asset so far.

    Sources are rows, not columns, so there may be thousands. A chunk is folded in order with its sources'
    prices kept sorted; it starts from head rows with the last price of every source before it.
    """
    scaled = readings.withColumn("scaled_price", D.rescale(F.col("price"), F.col("decimals"), F.lit(scale)))
    rows = add_chunk(scaled, "seq", size).withColumn("value", F.col("scaled_price").cast("string"))
    names = [c for c in rows.columns if c not in (CHUNK, "value")]
    heads = _entries(rows.select("asset", CHUNK, "source", "seq", "value")).withColumns(
        {"__head": F.lit(True), "seq": F.lit(-(2**62))})
    both = rows.withColumn("__head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    both = both.select("asset", CHUNK, "source", "value", "__head", *[F.col(c).alias(f"k_{c}") for c in names], "seq")

    def fold(batches):
        key, current, ordered = None, {}, []
        for batch in batches:
            medians = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for asset, chunk, source, value, head in zip(*columns):
                if (asset, chunk) != key:
                    key, current, ordered = (asset, chunk), {}, []
                if value is not None:
                    number = int(value)
                    if source in current:
                        del ordered[bisect_left(ordered, current[source])]
                    current[source] = number
                    insort(ordered, number)
                medians.append(None if head else D.middle(ordered))
            kept = pc.invert(batch.column(4))
            yield pa.RecordBatch.from_arrays(
                [*[c.filter(kept) for c in batch.columns[5:-1]], pa.array(medians, pa.string()).filter(kept)], [*names, "median"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in scaled.schema.fields) + "median string"
    lined = both.repartition("asset", CHUNK).sortWithinPartitions("asset", CHUNK, "seq")
    return lined.mapInArrow(fold, schema).withColumn("median", F.col("median").cast("decimal(38,1)"))


def breaker_state(
    readings: DataFrame,
    *,
    limit_pct: float = DEVIATION_LIMIT_PCT,
    recovery: int = RECOVERY_SUCCESSES,
    scale: int = 18,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Breaker state after every reading, in arrival order.

    A reading further than `limit_pct` from the cross-source median makes its
    (asset, source) suspicious until `recovery` good readings in a row. Positions
    and last deviations are found per chunk and offset by the chunk summaries.
    """
    seen = running_median(readings, scale=scale, size=size)
    seen = seen.withColumn("deviation", D.deviation_pct(F.col("scaled_price"), F.col("median")))
    seen = seen.withColumn("is_deviation", F.col("deviation") > limit_pct)
    seen = seen.drop("scaled_price")
    base = add_chunk(seen, "seq", size)

    part = ["asset", "source", CHUNK]
    order = W.partitionBy(*part).orderBy("seq")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    dev = F.col("is_deviation")
    local = base.withColumn("__n", F.row_number().over(order).cast("bigint")).withColumns({
        "__dev_at": F.max(F.when(dev, F.col("__n"))).over(upto),
        "deviations": F.sum(dev.cast("bigint")).over(upto),
        "last_suspicion": F.last(F.when(dev, F.col("timestamp")), ignorenulls=True).over(upto),
    })
    # Running values only grow, so their maxima are the chunk totals; the grouping
    # reuses the windows' partitioning.
    summary = local.groupBy(*part).agg(
        F.max("__n").alias("__rows"),
        F.max("__dev_at").alias("__at"),
        F.max("deviations").alias("__devs"),
        F.max_by("last_suspicion", "__n").alias("__dev_ts"),
    )
    earlier = W.partitionBy("asset", "source").orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    summary = summary.withColumn("__base", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    carry = summary.withColumns({
        "__c_at": F.max(F.col("__base") + F.col("__at")).over(earlier),
        "__c_devs": F.coalesce(F.sum("__devs").over(earlier), F.lit(0)),
        "__c_ts": F.last("__dev_ts", ignorenulls=True).over(earlier),
    }).select(*part, "__base", "__c_at", "__c_devs", "__c_ts")

    out = local.join(carry, part, "left")
    number = F.col("__base") + F.col("__n")
    dev_at = F.coalesce(F.col("__base") + F.col("__dev_at"), F.col("__c_at"))
    since = number - dev_at
    suspicious = F.coalesce(since < recovery, F.lit(False))
    return out.withColumns({
        "suspicious": suspicious,
        "deviations": F.col("deviations") + F.col("__c_devs"),
        "last_suspicion": F.coalesce("last_suspicion", "__c_ts"),
        "consecutive_successes": F.when(suspicious, since).otherwise(F.lit(0)).cast("bigint"),
    }).drop(CHUNK, "__n", "__dev_at", "__base", "__c_at", "__c_devs", "__c_ts")


def breaker_latest(states: DataFrame) -> DataFrame:
    """Current breaker state per (asset, source)."""
    return states.groupBy("asset", "source").agg(
        F.max_by("suspicious", "seq").alias("suspicious"),
        F.max_by("deviations", "seq").alias("deviations"),
        F.max_by("last_suspicion", "seq").alias("last_suspicion"),
        F.max_by("consecutive_successes", "seq").alias("consecutive_successes"),
    )


def breaker_metrics(states: DataFrame) -> DataFrame:
    """Totals and the list of suspicious pairs (bounded by assets x feeds)."""
    entry = F.struct(F.concat_ws(":", "asset", "source").alias("key"), "deviations")
    return breaker_latest(states).agg(
        F.count(F.lit(1)).alias("total_sources"),
        F.count_if("suspicious").alias("suspicious_sources"),
        F.array_sort(F.collect_list(F.when(F.col("suspicious"), entry))).alias("suspicious_list"),
    )


def trailing_medians(states: DataFrame, *, keep: int = MEDIAN_HISTORY, size: int = CHUNK_ROWS) -> DataFrame:
    """The last `keep` cross-source medians per asset at every reading."""
    slim = states.select("asset", "seq", "median")
    framed, order = with_halo(slim, ["asset"], "seq", keep - 1, size)
    trail = F.collect_list("median").over(order.rowsBetween(-(keep - 1), 0))
    return drop_halo(framed.withColumn("trail", trail)).drop("median")
