"""Anomaly scores over a price series: z-score, moving average, volatility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pricelake.operators.chunks import CHUNK_ROWS, drop_halo, with_halo


@dataclass(frozen=True)
class AnomalyConfig:
    """Fixed default values of the detectors."""

    window: int = 20
    warm_up: int = 5
    z_limit: float = 3.0
    average_limit_pct: float = 5.0
    volatility_factor: float = 3.0


DEFAULT = AnomalyConfig()


def _per_asset(field: str, default: AnomalyConfig, overrides: dict[str, AnomalyConfig] | None) -> Column:
    value = F.lit(float(getattr(default, field)))
    for asset, config in (overrides or {}).items():
        value = F.when(F.col("asset") == asset, float(getattr(config, field))).otherwise(value)
    return value


def score_series(
    series: DataFrame,
    *,
    value: str = "value",
    position: str = "tick",
    config: AnomalyConfig = DEFAULT,
    overrides: dict[str, AnomalyConfig] | None = None,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """All three detectors for every point of (asset ordered by position).

    They share one sort: frames reach at most `window` rows back, which each
    chunk receives as halo. Points with under `warm_up` predecessors score null.
    """
    w = config.window
    framed, order = with_halo(series, ["asset"], position, w, size)
    before = order.rowsBetween(-w, -1)
    last = F.lag(value).over(order)
    framed = framed.withColumns({
        "__n": F.count(value).over(before),
        "mean": F.avg(value).over(before),
        "std": F.stddev_pop(value).over(before),
        "__last": last,
        "__ret": F.when(last != 0, (F.col(value) - last) / last),
    })
    inner = order.rowsBetween(-(w - 1), -1)
    framed = framed.withColumns({
        "volatility": F.stddev_pop("__ret").over(inner),
        "__rets": F.count("__ret").over(inner),
    })
    out = drop_halo(framed)

    x, ready = F.col(value), F.col("__n") >= config.warm_up
    z_limit = _per_asset("z_limit", config, overrides)
    ma_limit = _per_asset("average_limit_pct", config, overrides)
    factor = _per_asset("volatility_factor", config, overrides)
    z = F.when(F.col("std") == 0, 0.0).otherwise(F.abs((x - F.col("mean")) / F.col("std")))
    moved = F.when(F.col("mean") == 0, 0.0).otherwise(F.abs(x - F.col("mean")) / F.col("mean") * 100)
    jump = F.when(F.col("__last") == 0, 0.0).otherwise(F.abs((x - F.col("__last")) / F.col("__last")))
    limit = F.col("volatility") * factor
    out = out.withColumns({
        "z": F.when(ready, z),
        "moved_pct": F.when(ready, moved),
        "jump": F.when(ready, jump),
    })
    usable = ready & (F.col("__rets") > 0)
    return out.withColumns({
        "z_score": F.when(ready, F.col("z") / z_limit),
        "z_anomaly": F.when(ready, F.col("z") > z_limit),
        "ma_score": F.when(ready, F.col("moved_pct") / ma_limit),
        "ma_anomaly": F.when(ready, F.col("moved_pct") > ma_limit),
        "vol_score": F.when(ready, F.when(usable & (limit != 0), F.col("jump") / limit).otherwise(0.0)),
        "vol_anomaly": F.when(ready, usable & (F.col("jump") > limit)),
        "vol_limit": F.when(usable, limit),
    }).drop("__n", "__last", "__ret", "__rets")


def anomaly_zscore(series: DataFrame, **options) -> DataFrame:
    return _detector(series, "z", "zscore", options)


def anomaly_moving_avg(series: DataFrame, **options) -> DataFrame:
    return _detector(series, "ma", "moving_average", options)


def anomaly_volatility(series: DataFrame, **options) -> DataFrame:
    return _detector(series, "vol", "volatility", options)


def _detector(series: DataFrame, short: str, method: str, options: dict) -> DataFrame:
    position = options.get("position", "tick")
    scored = score_series(series, **options).filter(F.col(f"{short}_score").isNotNull())
    return scored.select(
        "asset", position, F.lit(method).alias("method"), F.col(f"{short}_score").alias("score"),
        F.col(f"{short}_anomaly").alias("is_anomaly"))


def anomaly_best(series: DataFrame, **options) -> DataFrame:
    """The firing detector with the highest score; ties go to the later one."""
    position = options.get("position", "tick")
    scored = score_series(series, **options)
    texts = {
        "z": F.format_string("z=%.3f, mean=%.6f, stdDev=%.6f", "z", "mean", "std"),
        "ma": F.format_string("deviation=%.2f%%, ma=%.6f", "moved_pct", "mean"),
        "vol": F.format_string(
            "return=%.3f%%, vol=%.3f%%", F.col("jump") * 100, F.coalesce(F.col("volatility"), F.lit(0.0)) * 100),
    }
    methods = {"z": "zscore", "ma": "moving_average", "vol": "volatility"}
    fired = F.array(*[
        F.when(F.col(f"{s}_anomaly"), F.struct(
            F.col(f"{s}_score").alias("score"), F.lit(i).alias("rank"), F.lit(methods[s]).alias("method"),
            texts[s].alias("details")))
        for i, s in enumerate(("z", "ma", "vol"))
    ])
    best = F.array_max(fired)
    out = scored.withColumn("__best", best).filter(F.col("__best").isNotNull())
    return out.select(
        "asset", position, F.col("__best.method").alias("method"), F.col("__best.score").alias("score"),
        F.col("__best.details").alias("details"))


def false_positive_rate(feedback: DataFrame) -> DataFrame:
    """Share of reported anomalies that were no anomalies, per asset."""
    counts = feedback.groupBy("asset").agg(
        F.count_if(~F.col("is_true")).alias("fp"), F.count(F.lit(1)).alias("n"))
    return counts.select("asset", F.when(F.col("n") == 0, 0.0).otherwise(F.col("fp") / F.col("n")).alias("rate"))
