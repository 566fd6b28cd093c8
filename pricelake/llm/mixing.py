"""Mixing sources to target weights with DataFrame functions only.

Words are summed per source (a hash aggregation with map-side combine, so a source
with a third of all rows is no hot task), the word budget is shared among the sources
by weight under a cap per source, and every document is repeated floor(rate) times
plus one copy drawn by a coin that depends on its id and the seed alone.

Defined results: a null text has size 0; null sources are one source of their own,
ordered last; a source without words has target 0 and rate 0; rows with equal ids
(also null ids) share one coin; repeated rows are separate documents; an empty table
gives an empty result. Other columns pass through `emit` untouched; helper columns
are dropped, so a column of the input with a helper's name would be replaced - they
all begin with `mix_`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters (ASCII spaces only); null counts 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def cycle_weights(sources: DataFrame, cycle: Sequence[float]) -> DataFrame:
    """Weights from a repeating list, dealt to the sources by code point, null last.

    One row per source goes through a single ordered window.
    """
    order = F.row_number().over(W.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    return sources.withColumn(
        "mix_weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (order % len(cycle) + 1).cast("int")))


def share_budget(sources: DataFrame, budget: float, cap: float) -> DataFrame:
    """Adds `mix_target`: `budget` times all words, shared by weight, at most `cap` times a source's own.

    The excess of capped sources is shared again by weight among the others. Sorted by
    cap per weight, the capped sources come first: one is capped if its cap is no more
    than its share of what those before it leave.
    """
    ordered = W.orderBy(F.col("mix_cap") / F.col("mix_weight"), F.col("mix_source").asc_nulls_last())
    before, onward = ordered.rowsBetween(W.unboundedPreceding, -1), ordered.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    left = F.sum("mix_source_size").over(every) * budget - F.coalesce(F.sum("mix_cap").over(before), F.lit(0.0))
    out = sources.withColumn("mix_cap", F.col("mix_source_size") * cap).withColumns({
        "mix_left": left, "mix_open": F.sum("mix_weight").over(onward)})
    out = out.withColumn("mix_capped", F.col("mix_cap") * F.col("mix_open") <= F.col("mix_left") * F.col("mix_weight"))
    level = F.min(F.when(~F.col("mix_capped"), F.struct(
        F.col("mix_cap") / F.col("mix_weight"), F.col("mix_left") / F.col("mix_open")))).over(every).getField("col2")
    return out.withColumn(
        "mix_target", F.when(F.col("mix_capped"), F.col("mix_cap")).otherwise(F.col("mix_weight") * level)
    ).select("mix_source", "mix_source_size", "mix_target")


def repetitions(
    docs: DataFrame,
    cycle: Sequence[float] = (5, 2, 1),
    budget: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every document with `mix_size`, `mix_source_size`, `mix_target` and `mix_copies`."""
    sized = docs.withColumns({"mix_size": word_count(F.col(text_col)), "mix_source": F.col(source_col)})
    sums = sized.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_source_size"))
    targets = share_budget(cycle_weights(sums, cycle), budget, cap).withColumnRenamed("mix_source", "mix_key")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    coin = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    whole = F.floor("mix_rate")
    return (
        sized.join(targets, F.col("mix_source").eqNullSafe(F.col("mix_key")))
        .withColumn("mix_rate", rate)
        .withColumn("mix_copies", whole + F.when(coin < F.col("mix_rate") - whole, 1).otherwise(0))
        .drop("mix_key", "mix_source", "mix_rate")
    )


def emit(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is repeated, with the columns of `docs`."""
    counted = repetitions(docs, **settings).filter(F.col("mix_copies") > 0)
    copies = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
