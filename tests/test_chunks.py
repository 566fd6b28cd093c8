import random

import pytest
from pyspark.sql import Window as W, functions as F

from pricelake.operators.chunks import drop_halo, running, top_per_key, with_halo


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(s * rng.choice([1, 3]) + s, "hot" if rng.random() < 0.7 else rng.choice("abc"), rng.choice([None, *range(9)]))
            for s in range(0, 2000, 4)]
    return spark.createDataFrame(data, "seq bigint, k string, v int").dropDuplicates(["seq"]).cache()


@pytest.mark.parametrize("size", [5, 100, 10**6])
@pytest.mark.parametrize("keys", [["k"], []])
def test_running_equals_plain_window(rows, size, keys):
    w = W.partitionBy(*keys).orderBy("seq")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    want = rows.select(
        "seq", F.sum("v").over(upto).alias("a"), F.min("v").over(upto).alias("b"), F.max("v").over(before).alias("c"),
        F.last("v", ignorenulls=True).over(before).alias("d"), F.last("v", ignorenulls=True).over(upto).alias("e"))
    v = F.col("v")
    got = running(rows, keys, "seq", {"a": ("sum", v), "b": ("min", v), "c": ("max", v), "d": ("last", v), "e": ("last", v)},
                  size, exclusive=["c", "d"]).select("seq", "a", "b", "c", "d", "e")
    assert set(got.collect()) == set(want.collect())


@pytest.mark.parametrize("size", [5, 100, 10**6])
@pytest.mark.parametrize("shared", [False, True])
def test_least_sums_next_values_and_null_keys(rows, size, shared):
    rows = rows.withColumn("k", F.when(F.col("k") != "a", F.col("k"))).withColumn("v", F.col("v") - 4)
    w = W.partitionBy("k").orderBy("seq")
    upto, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1, W.unboundedFollowing)
    odd = F.when(F.col("v") % 2 == 1, F.col("v"))
    want = rows.withColumn("s", F.sum("v").over(upto)).select(
        "seq", "k", "s", F.min("s").over(upto).alias("low"), F.first(odd, ignorenulls=True).over(after).alias("next"),
        F.last(odd, ignorenulls=True).over(upto).alias("last"))
    v = F.col("v")
    got = running(rows, ["k"], "seq", {"s": ("sum", v), "low": ("low", v), "next": ("next", odd), "last": ("last", odd)},
                  size, exclusive=["next"], shared=shared)
    assert got.columns == ["seq", "k", "v", "s", "low", "next", "last"]
    assert set(got.drop("v").collect()) == set(want.collect())


@pytest.mark.parametrize("name,scans", [("stake_balance", 1), ("incidents", 1), ("reputation", 1)])
def test_one_scan_of_the_input(spark, sf, name, scans):
    """In the plan that ran, adaptive reuse included."""
    import pricelake.plans.all  # noqa: F401
    from pricelake.plans.registry import PLANS

    df = PLANS[name](spark, sf)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == scans and "ReusedExchange" in final


@pytest.mark.parametrize("size", [3, 50, 10**6])
@pytest.mark.parametrize("k", [1, 20])
def test_halo_equals_plain_window(rows, size, k):
    frame = lambda o: F.collect_list("seq").over(o.rowsBetween(-k, -1))
    want = rows.select("seq", frame(W.partitionBy("k").orderBy("seq")).alias("x"))
    full, order = with_halo(rows, ["k"], "seq", k, size)
    got = drop_halo(full.withColumn("x", frame(order))).select("seq", "x")
    assert {(r.seq, tuple(r.x)) for r in got.collect()} == {(r.seq, tuple(r.x)) for r in want.collect()}


def test_top_per_key_limits_before_the_shuffle(rows):
    top = top_per_key(rows, ["k"], [F.col("seq").desc()], 3)
    assert top.count() == 12
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") and plan.count("WindowGroupLimit") == 2
