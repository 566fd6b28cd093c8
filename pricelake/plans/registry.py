"""Named plans and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"plan {name} registered twice")
        PLANS[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register
