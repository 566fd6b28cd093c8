"""Streaming consensus, alerts and usage: the cut into micro-batches and restarts do not matter."""

import os
import pickle

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pricelake.operators import breaker, consensus
from pricelake.plans.inputs import readings
from pricelake.streaming import jobs, ticks

POLL, STALE = 3600, 7200
SCHEMA = "seq bigint, asset string, source string, price decimal(38,0), decimals int, timestamp bigint"


@pytest.fixture(scope="module")
def data(spark, sf):
    """Readings with a fifth source that no list names, and one asset that falls silent."""
    df = readings(spark, sf).withColumn("source", F.when(F.col("seq") % 11 == 0, "fifth").otherwise(F.col("source")))
    quiet = (F.col("asset") == "ETH") & (F.col("timestamp") > 1_704_400_000)
    return df.filter(~quiet)


def land(df, path, parts, first=0, last=None):
    total = 1000
    for i in range(first, last if last is not None else parts):
        low, high = i * total // parts, (i + 1) * total // parts
        df.filter(F.col("seq").between(low, high - 1)).withColumn("price", F.col("price").cast("string")).coalesce(
            1).write.mode("append").json(path)


def open_stream(spark, path, per_batch=None):
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).json(path)


def consensus_of(stream):
    return ticks.stream_consensus(stream, staleness=STALE, poll=POLL, limit_pct=90.0)


def rows(spark, path, order):
    return sorted((tuple(map(str, r)) for r in spark.read.parquet(path).select(*order).collect()))


COLUMNS = ["asset", "tick", "price", "decimals", "sources", "timestamp", "confidence", "level", "stale"]


def test_consensus_equals_the_batch_series(spark, data, tmp_path):
    """Against the batch operators, with the breaker, up to the last tick that the watermark passes."""
    land(data, str(tmp_path / "in"), 1)
    jobs.run_available(consensus_of(open_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    newest = data.agg(F.max("timestamp")).first()[0]
    last = (newest - 120) // POLL
    states = breaker.breaker_state(data, limit_pct=90.0)
    want = consensus.consensus_series(
        states.filter(F.col("timestamp") <= last * POLL), last_tick=F.lit(last), staleness=STALE, poll=POLL)
    want = sorted(tuple(map(str, r)) for r in want.select(*COLUMNS).collect())
    got = rows(spark, str(tmp_path / "out"), COLUMNS)
    assert got == want
    assert any(r[-1] == "True" for r in got) and any("fifth" in r[4] for r in got)


@pytest.fixture(scope="module")
def one_batch(spark, data, tmp_path_factory):
    """Consensus and alerts of all readings at once."""
    base = str(tmp_path_factory.mktemp("once"))
    land(data, f"{base}/in", 1)
    stream = consensus_of(open_stream(spark, f"{base}/in"))
    jobs.run_available(alerts_of(spark, stream), f"{base}/alerts", f"{base}/ck")
    return rows(spark, f"{base}/alerts", ALERTS)


ALERTS = ["asset", "kind", "timestamp", "type", "message", "previous_price", "current_price", "deviation_percent", "affected_sources"]


def alerts_of(spark, stream):
    limits = spark.createDataFrame(
        [("BTC", 40.0, 3600.0, 2.0), ("ETH", 60.0, 9000.0, 1.0), ("XLM", 0.0, 0.0, 1.0)],
        "asset string, deviation_pct double, stale_s double, source_down double")
    return ticks.stream_alerts(stream, limits, period_s=43200, disagreement_pct=5.0, poll=POLL)


def test_twenty_batches_and_a_restart_give_the_same_alerts(spark, data, one_batch, tmp_path):
    """Two runs over one checkpoint, a file a micro-batch; the second sees the other half of the files."""
    base = str(tmp_path)
    for first, last in ((0, 9), (9, 20)):
        land(data, f"{base}/in", 20, first, last)
        stream = alerts_of(spark, consensus_of(open_stream(spark, f"{base}/in", per_batch=1)))
        jobs.run_available(stream, f"{base}/alerts", f"{base}/ck")
    assert rows(spark, f"{base}/alerts", ALERTS) == one_batch
    kinds = {r[1] for r in one_batch}
    assert kinds == {"deviation", "stale", "source_down", "disagreement"}


def test_alerts_are_held_back_per_asset_and_kind(one_batch):
    last = {}
    for asset, kind, at, *_ in sorted(one_batch, key=lambda r: int(r[2])):
        assert int(at) - last.get((asset, kind), -10**9) >= 43200
        last[asset, kind] = int(at)
    silent = [r for r in one_batch if r[0] == "ETH" and r[1] == "source_down"]
    assert len(silent) > 2  # an asset that is silent goes on to be reported


def test_exact_helpers():
    assert ticks.middle([]) is None and ticks.middle([3]) == "3.0" and ticks.middle([1, 2]) == "1.5"
    assert ticks.middle([-3, -2]) == "-2.5" and ticks.middle([-1, 0]) == "-0.5" and ticks.middle([1, 10**37]) is None
    assert ticks.rescaled(15, 1, 0) == 2 and ticks.rescaled(-15, 1, 0) == -2 and ticks.rescaled(14, 1, 0) == 1
    assert ticks.rescaled(10**37, 0, 1) is None and ticks.rescaled(7, 0, 3) == 7000
    assert [ticks.level_of(u, 4, False) for u in (0, 1, 2, 4)] == ["critical", "critical", "degraded", "healthy"]


def test_messages_round_as_the_batch(spark):
    from pricelake.operators import alerts

    values = [1240.625, 0.005, 1.005, 2.675, 12.345, 99.995, 7.0, 123456.785, 1e19, 3e25, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.t for r in df.select(alerts.filled(alerts.DISAGREEMENT_TEXT, asset=F.lit("A"), pct=F.col("v")).alias("t")).collect()]
    assert got == [alerts.DISAGREEMENT_TEXT.format(asset="A", pct=ticks._two_places(v)) for v in values]


def test_usage_leaves_the_sink_after_its_retention(spark, tmp_path):
    """Hours of 200 days in two runs of one job: what is older than 90 days is gone, the rest stays once."""
    hour, base = 3_600_000, str(tmp_path)
    schema = "endpoint string, method string, api_key_prefix string, asset string, timestamp bigint"
    requests = spark.range(200 * 24).selectExpr(
        "'/x' AS endpoint", "'GET' AS method", "concat('key-', id % 2) AS api_key_prefix", "CAST(NULL AS STRING) AS asset",
        f"id * {hour}L + 1 AS timestamp", "id").repartition(1)
    newest = []
    for first, last in ((0, 120), (120, 200)):
        requests.filter(F.col("id").between(first * 24, last * 24 - 1)).drop("id").coalesce(1).write.mode("append").json(f"{base}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{base}/in")
        for _ in range(2):  # the second time there is nothing new
            jobs.run_usage(jobs.stream_usage(stream), f"{base}/out", f"{base}/ck")
        got = jobs.read_usage(spark, f"{base}/out").filter("dimension = 'total'").collect()
        hours = sorted(r.hour for r in got)
        newest.append(max(hours))
        assert hours == list(range(max(hours) - (90 * 24 - 1) * hour, max(hours) + 1, hour)) and {r["count"] for r in got} == {1}
        days = [int(d.split("=")[1]) for d in os.listdir(f"{base}/out") if d.startswith("day=")]
        assert min(days) + jobs.DAY_MS > max(days) - 90 * 24 * hour
    assert newest[1] > newest[0] + 79 * 24 * hour


def test_usage_plan_gives_every_hour(spark, tmp_path):
    """Hours of 60 days: none is too old for the result."""
    from pricelake.plans.streams import stream_usage

    hours = range(60 * 24)
    pq.write_table(pa.table({
        "event_id": list(hours), "ts": pa.array([(1704067200 + h * 3600 + 1) * 10**6 for h in hours], pa.timestamp("us")),
        "user_id": [h % 5 for h in hours], "event_type": ["view"] * len(hours), "value": [1.0] * len(hours)}),
        str(tmp_path / "events.parquet"))
    got = stream_usage(spark, str(tmp_path)).filter("dimension = 'total'").collect()
    assert sorted(r.hour for r in got) == [(1704067200 + h * 3600) * 1000 for h in hours[:-2]]


class _Store:
    """A state variable in a dict, with the bytes that were written to it."""

    def __init__(self):
        self.held, self.written = {}, 0

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value
        self.written += len(pickle.dumps(value))

    def removeKey(self, key):
        del self.held[key]

    def iterator(self):
        return iter(list(self.held.items()))

    def get(self):
        return self.held.get(())

    def update(self, value):
        self.held[()] = value


class _Handle:
    def __init__(self):
        self.stores = []

    def getMapState(self, *_):
        self.stores.append(_Store())
        return self.stores[-1]

    getValueState = getMapState

    def registerTimer(self, _):
        pass

    deleteTimer = registerTimer


def test_state_written_grows_with_the_rows(monkeypatch):
    """Copies of one range of ticks, one after the other: waiting rows are not written again for each."""
    monkeypatch.setattr(ticks, "PART_ROWS", 500, raising=False)
    written = []
    for copies in (4, 16):
        operator, handle = ticks.TickConsensus(STALE, POLL, 90.0, 3, 8), _Handle()
        operator.init(handle)
        frames = (pd.DataFrame({
            "asset": "A", "seq": [c * 500 + i for i in range(500)], "source": [f"s{i % 4}" for i in range(500)],
            "price": [str(100 + i % 7) for i in range(500)], "decimals": 2, "timestamp": [i * 60 + 1 for i in range(500)],
            "tick": [i // 60 + 1 for i in range(500)]}) for c in range(copies))
        operator.handleInputRows(("A",), frames, None)
        written.append(sum(s.written for s in handle.stores))
    assert written[1] < 4.4 * written[0]
    taken = [(tick, len(rows)) for tick, rows in operator._taken(range(1, 8))]
    assert taken == [(t, 16 * 60) for t in range(1, 8)]
    # What is beyond the ticks that were taken waits on; taken rows are gone.
    assert [len(rows) for _, rows in operator._taken(range(1, 12))] == [0] * 7 + [16 * 60, 16 * 20, 0, 0]
