import random

import pytest
from pyspark.sql import functions as F

from pricelake.operators import anomaly, breaker, ledger, sequential
from pricelake.operators.chunks import add_chunk
from tests import simulate

SIZES = [7, 64, 10_000]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("bps", [100, 2000, 9999, 15000])
def test_guard(spark, size, bps):
    rows = simulate.series(bps, 900, ["A", "B", "C"], negatives=True)
    df = spark.createDataFrame([(s, k, p) for s, k, p, _ in rows], "seq bigint, asset string, price bigint")
    df = df.selectExpr("seq", "asset", "cast(price as decimal(38,0)) price")
    got = {r.seq: r.accepted for r in sequential.guard_replay(df, bps=bps, size=size).collect()}
    assert got == simulate.guard(rows, bps)


def test_guard_keeps_wide_prices(spark):
    big = 10**37
    df = spark.createDataFrame([(0, "A", str(big)), (1, "A", str(big + big // 10)), (2, "A", str(3 * big))],
                               "seq bigint, asset string, price string")
    out = sequential.guard_replay(df.selectExpr("seq", "asset", "cast(price as decimal(38,0)) price"), size=1)
    assert [(r.seq, r.accepted, int(r.price)) for r in out.orderBy("seq").collect()] == [
        (0, True, big), (1, True, big + big // 10), (2, False, 3 * big)]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("seed,rate", [(1, 0.3), (2, 0.6), (3, 0.05), (4, 0.95)])
def test_feed_breaker(spark, size, seed, rate):
    rng, ts, rows = random.Random(seed), 0, []
    for seq in range(1200):
        ts += rng.choice([0, 500, 4000, 9000, 40000])
        rows.append((seq, rng.choice("xyz") if rng.random() < 0.6 else "x", ts, rng.random() > rate))
    df = spark.createDataFrame(rows, "seq bigint, source string, ts_ms bigint, ok boolean")
    out = sequential.feed_breaker(df, size=size)
    got = {r.seq: (r.allowed, r.state, r.failures, r.trips) for r in out.collect()}
    assert got == simulate.feed_breaker(rows, 3, 30_000, 2)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quota(spark, seed):
    rng, ts, rows = random.Random(seed), 10**9, []
    for seq in range(2500):
        ts += rng.choice([0, 0, 10, 200, 2500, 90_000 if rng.random() < 0.05 else 1])
        rows.append((seq, rng.choice(["k1", "k1", "k2", "k3", "other"]), ts))
    limits = {"k1": 20, "k2": 3, "k3": 1000}
    df = spark.createDataFrame(rows, "seq bigint, key string, ts_ms bigint")
    lim = spark.createDataFrame(list(limits.items()), "key string, limit bigint")
    got = {r.seq: (r.allowed, r.retry_after_s) for r in sequential.quota_replay(df, lim).collect()}
    assert got == simulate.quota(rows, limits)


@pytest.mark.parametrize("kind,limit", [("waves", 30), ("waves", 200), ("flood", 40), ("flood", 3), ("edge", 120)])
def test_quota_in_chunks(spark, kind, limit):
    """A key that is over its limit for hours, with and without breaks in which chunks settle."""
    rng, ts, rows = random.Random(limit), 10**9, []
    for seq in range(12_000):
        calm = kind == "waves" and (ts // 200_000) % 2
        ts += rng.choice([0, 0, 1, 400, 900] if not calm else [0, 1500, 4000]) if kind != "edge" else rng.choice([400, 500, 600])
        rows.append((seq, "hot" if rng.random() < 0.97 else "cold", ts))
    limits = {"hot": limit, "cold": 2}
    df = spark.createDataFrame(rows, "seq bigint, key string, ts_ms bigint").repartition(4)
    lim = spark.createDataFrame(list(limits.items()), "key string, limit bigint")
    out = sequential.quota_replay(df, lim, chunk_ms=300_000)
    got = {r.seq: (r.allowed, r.retry_after_s) for r in out.collect()}
    assert got == simulate.quota(rows, limits)


def test_a_hot_key_runs_in_several_tasks(spark):
    """10^6 requests of one key that never falls below its limit are judged in many tasks."""
    df = spark.range(1_000_000).selectExpr(
        "id AS seq", "'hot' AS key", "1000000000 + id * 20 + pmod(xxhash64(id), 19) AS ts_ms")
    lim = spark.createDataFrame([("hot", 2990)], "key string, limit bigint")
    part = [*sequential._PART]
    seen = []
    scan = sequential._scan

    def spy(frame, keys, *rest):
        seen.append((keys, frame.select(*keys).distinct().count()))
        return scan(frame, keys, *rest)

    sequential._scan = spy
    try:
        out = sequential.quota_replay(df, lim).persist()
    finally:
        sequential._scan = scan
    assert all(n > 20 for keys, n in seen if keys == part) and ["key", "run"] in [k for k, _ in seen]
    sample = out.filter("seq < 30000").collect()
    rows = sorted((r.seq, r.key, r.ts_ms) for r in sample)
    assert {r.seq: (r.allowed, r.retry_after_s) for r in sample} == simulate.quota(rows, {"hot": 2990})
    allowed = out.filter("allowed").groupBy(F.floor(F.col("ts_ms") / 60_000).alias("m")).count().collect()
    assert max(r["count"] for r in allowed) <= 2 * 2990 and out.count() == 1_000_000


@pytest.mark.parametrize("size", SIZES)
def test_webhook_interval(spark, size):
    rows = simulate.series(5, 800, ["A", "B"], step=30_000)
    first = rows[0][3]
    hooks = [("h1", "A", first, 0.0), ("h2", "A", first + 500_000, 200_000.0), ("h3", "B", first, 1_000_000.0)]
    reg = spark.createDataFrame([(h, "interval", a, v, c) for h, a, c, v in hooks],
                                "id string, type string, asset string, value double, created_ms bigint")
    upd = spark.createDataFrame([(s, k, p, t) for s, k, p, t in rows], "seq bigint, asset string, price bigint, ts_ms bigint")
    got = {}
    for r in sequential.webhook_interval(reg, upd, size=size).collect():
        got.setdefault(r.id, set()).add(r.ts_ms)
    assert got == simulate.interval_fires(hooks, [(s, k, t) for s, k, _, t in rows], 60_000)


@pytest.mark.parametrize("size", SIZES)
def test_deviation_breaker(spark, size):
    rng = random.Random(9)
    rows = [(s, rng.choice("AB"), rng.choice(["chainlink", "redstone", "band", "reflector"]),
             rng.choice([100, 101, 99, 103, 150, 0]), s * 10) for s in range(1200)]
    df = spark.createDataFrame(rows, "seq bigint, asset string, source string, price bigint, timestamp bigint")
    df = df.selectExpr("seq", "asset", "source", "cast(price as decimal(38,0)) price", "0 decimals", "timestamp")
    out = breaker.breaker_state(df, scale=0, size=size)
    got = {r.seq: (r.suspicious, r.deviations, r.last_suspicion, r.consecutive_successes) for r in out.collect()}
    assert got == simulate.deviation_breaker(rows, 20, 3)


@pytest.mark.parametrize("size", SIZES)
def test_anomaly_scores(spark, size):
    rng = random.Random(4)
    data = {a: [rng.choice([0.0, 10.0]) if rng.random() < 0.05 else 100 + rng.gauss(0, 3) for _ in range(300)] for a in "AB"}
    rows = [(a, 3 * i, v) for a, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "asset string, tick bigint, value double")
    out = anomaly.score_series(df, size=size).orderBy("asset", "tick").collect()
    for a, vs in data.items():
        mine = [r for r in out if r.asset == a]
        for r, want in zip(mine, simulate.anomaly(vs)):
            if want is None:
                assert r.z_score is None
            else:
                assert (r.z_score, r.ma_score, r.vol_score) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("size", SIZES)
def test_stakes(spark, size):
    rng = random.Random(7)
    rows = [(s, rng.choice("ab"), rng.choice(["stake", "slash"]), rng.randint(1, 50)) for s in range(600)]
    df = spark.createDataFrame(rows, "seq bigint, source string, kind string, amount bigint")
    got = {r.seq: int(r.balance) for r in ledger.stake_balance(df, size=size).collect()}
    assert got == simulate.stakes(rows)


def test_chunks_are_bounded(spark):
    df = spark.range(-50, 1000).withColumnRenamed("id", "seq")
    counts = [r["count"] for r in add_chunk(df, "seq", 100).groupBy("__chunk").count().collect()]
    assert max(counts) <= 100 and len(counts) == 11


@pytest.mark.parametrize("size", [50, 1000, 10**6])
def test_running_median_over_a_thousand_sources(spark, size):
    """Against sorting the newest arrivals at every reading; no column a source and no job while planning."""
    rng, rows, newest = random.Random(size), [], {}
    for seq in range(0, 9000, 3):
        asset, source = rng.choice("AB"), f"s{int(rng.random() ** 3 * 1000)}"
        rows.append((seq, asset, source, str(rng.choice([rng.randint(-50, 50), rng.randint(1, 10**6), 10**37])), 0, seq))
    df = spark.createDataFrame(rows, "seq bigint, asset string, source string, price string, decimals int, timestamp bigint")
    df = df.withColumn("price", F.col("price").cast("decimal(38,0)"))
    spark.sparkContext.setJobGroup(f"planning {size}", "")
    out = breaker.running_median(df, scale=0, size=size)
    breaker.breaker_state(df, scale=0, size=size)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"planning {size}")
    spark.sparkContext.setJobGroup("", "")
    assert len(out.columns) == len(df.columns) + 2
    got = {r.seq: r.median for r in out.collect()}
    for seq, asset, source, price, _, _ in rows:
        newest.setdefault(asset, {})[source] = int(price)
        ordered = sorted(newest[asset].values())
        low, high = ordered[(len(ordered) - 1) // 2], ordered[len(ordered) // 2]
        want = None if max(abs(low), abs(high)) >= 10**37 else (low + high) / 2
        assert (None if got[seq] is None else float(got[seq])) == want
