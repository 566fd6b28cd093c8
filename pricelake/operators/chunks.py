"""Ordered computations that stay parallel when one key holds most rows.

A window over `partitionBy(asset)` puts a whole asset into one task. The helpers
here cut every key's order into chunks of bounded size instead:

* `running` - running sum/min/max/last and the like: local value inside the chunk, combined
  with a carry-in taken from the chunk summaries (one row per key and chunk);
* `with_halo` - bounded ROWS frames: each chunk also receives the last `k` rows
  that precede it, which are dropped again after the window.

A chunk is `position div size`. Positions are unique within a key (`seq`, or a
poll tick), so a chunk never holds more than `size` rows of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_ROWS = 250_000
CHUNK = "__chunk"
HALO = "__halo"
KEY = "__key"


def add_chunk(df: DataFrame, position: str, size: int = CHUNK_ROWS) -> DataFrame:
    n = int(size)
    return df.withColumn(CHUNK, F.expr(f"(`{position}` - pmod(`{position}`, {n}L)) div {n}L"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: Mapping[str, tuple[str, Column]],
    size: int = CHUNK_ROWS,
    exclusive: Sequence[str] = (),
    shared: bool = False,
) -> DataFrame:
    """Add running aggregates over (keys ordered by position).

    `values` maps a new column to (kind, expression), kind one of sum, min, max, last (last
    non-null), next (first non-null from here on) and low (least running sum so far). Columns
    named in `exclusive` leave the current row out.

    Chunk summaries are aggregated from the input, which is combined before the exchange; that reads
    the input once more. Where the input is itself the work of windows and joins, pass `shared` and
    only columns that are needed after it: summaries then come from the rows' own exchange, which Spark
    runs once for both if both ask for the same columns, so a summary carries its last row as a whole.
    """
    # A struct is never null itself, so rows with null keys find their carry too. The key's columns travel in it.
    base = add_chunk(df, position, size).withColumns(
        {KEY: F.struct(*keys) if keys else F.lit(0)} | {f"__v_{name}": expr for name, (_, expr) in values.items()})
    base = base.drop(*keys)
    part = [KEY, CHUNK]
    within = W.partitionBy(*part).orderBy(position)
    upto, before = within.rowsBetween(W.unboundedPreceding, 0), within.rowsBetween(W.unboundedPreceding, -1)
    # What follows is what precedes in falling order: a frame that only grows, where one that shrinks costs a pass a row.
    falling = W.partitionBy(*part).orderBy(F.col(position).desc())
    onward, after = falling.rowsBetween(W.unboundedPreceding, 0), falling.rowsBetween(W.unboundedPreceding, -1)
    call = {"sum": F.sum, "low": F.sum, "min": F.min, "max": F.max}
    pick = lambda value: F.last(value, ignorenulls=True)

    sums, local, total = {}, {}, {}
    for name, (kind, _) in values.items():
        value, aside = F.col(f"__v_{name}"), name in exclusive
        if kind == "low":
            sums[f"__s_{name}"] = F.sum(value).over(upto)
            local[name] = F.min(f"__s_{name}").over(before if aside else upto)
            total |= {f"__t_{name}": F.sum(value), f"__m_{name}": F.min(f"__s_{name}")}
        elif kind == "next":
            local[name] = pick(value).over(after if aside else onward)
            total[f"__t_{name}"] = F.min_by(value, F.when(value.isNotNull(), F.col(position)))
        elif kind == "last":
            local[name] = pick(value).over(before if aside else upto)
            total[f"__t_{name}"] = F.max_by(value, F.when(value.isNotNull(), F.col(position)))
        else:
            local[name] = call[kind](value).over(before if aside else upto)
            total[f"__t_{name}"] = call[kind](value)
    windowed = base.withColumns(sums).withColumns(local)

    summary = windowed if shared or sums else base
    if shared:
        total["__row"] = F.max_by(F.struct(*windowed.columns), F.col(position))
    summary = summary.groupBy(*part).agg(*[expr.alias(name) for name, expr in total.items()])
    if shared:
        # The whole row is asked for, or the optimizer would drop it.
        summary = summary.filter(F.col("__row").isNotNull() & (F.hash("__row") >= -(1 << 31)))
    earlier = W.partitionBy(KEY).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(KEY).orderBy(F.col(CHUNK).desc()).rowsBetween(W.unboundedPreceding, -1)
    carry, lows = {}, {}
    for name, (kind, _) in values.items():
        whole = F.col(f"__t_{name}")
        carry[f"__c_{name}"] = pick(whole).over(earlier if kind == "last" else later) if kind in (
            "last", "next") else call[kind](whole).over(earlier)
        if kind == "low":
            lows[f"__d_{name}"] = F.min(F.coalesce(f"__c_{name}", F.lit(0)) + F.col(f"__m_{name}")).over(earlier)
    carried = summary.withColumns(carry).withColumns(lows).select(*part, *carry, *lows)

    out = windowed.join(carried, part, "left")
    final = {}
    for name, (kind, _) in values.items():
        mine, prior = F.col(name), F.col(f"__c_{name}")
        if kind in ("last", "next"):
            final[name] = F.coalesce(mine, prior)
        elif kind == "sum":
            final[name] = F.when(mine.isNull(), prior).when(prior.isNull(), mine).otherwise(mine + prior)
        elif kind == "low":
            final[name] = F.least(F.col(f"__d_{name}"), mine + F.coalesce(prior, F.lit(0)))
        else:
            final[name] = (F.least if kind == "min" else F.greatest)(mine, prior)
    names = [c for c in df.columns if c not in values]
    return out.withColumns(final).select(
        *[F.col(KEY)[c].alias(c) if c in keys else F.col(f"`{c}`") for c in names], *values)


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    k: int,
    size: int = CHUNK_ROWS,
) -> tuple[DataFrame, object]:
    """Chunked copy of `df` where each chunk also holds its `k` preceding rows.

    Returns the frame (column `__halo` marks the extra rows) and the window
    specification to use; filter `~__halo` after the window expressions.
    """
    base = add_chunk(df, position, size)
    part = [*keys, CHUNK]
    newest = W.partitionBy(*part).orderBy(F.col(position).desc())
    tails = base.withColumn("__rn", F.row_number().over(newest)).filter(F.col("__rn") <= k).drop("__rn")
    # Chunks are listed by their tails alone: the k tail rows after a row tell
    # which later chunks have it among their k predecessors.
    following = W.partitionBy(*keys).orderBy(position).rowsBetween(1, k)
    first_of_chunk = W.partitionBy(*keys).orderBy(position)
    counted = tails.withColumn(
        "__starts", F.lag(CHUNK).over(first_of_chunk) != F.col(CHUNK)
    ).withColumn(
        "__targets",
        F.collect_set(F.when(F.col("__starts"), F.col(CHUNK))).over(following),
    )
    halo = (
        counted.select("*", F.explode("__targets").alias("__target"))
        .withColumn(CHUNK, F.col("__target"))
        .drop("__target", "__targets", "__starts")
        .withColumn(HALO, F.lit(True))
    )
    full = base.withColumn(HALO, F.lit(False)).unionByName(halo)
    return full, W.partitionBy(*part).orderBy(position)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO, CHUNK)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first `n` rows per key; Spark keeps only `n` per key before the shuffle."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)
