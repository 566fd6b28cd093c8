import tracemalloc
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelake.plans.inputs import readings
from pricelake.sources import export, feeds, history
from pricelake.streaming import jobs
from pricelake.operators import sequential


@pytest.fixture
def data(spark, sf):
    return readings(spark, sf)


def test_range_prunes_chunks_and_pushes_filters(spark, data, tmp_path):
    path = str(tmp_path / "h")
    history.write_history(data, path)
    df = history.scan_history_table(spark, path, asset="BTC", start=1704672000, end=1705276800).select("price")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk" in plan and "EqualTo(asset,BTC)" in plan
    assert "GreaterThanOrEqual(timestamp," in plan and "source" not in plan.split("ReadSchema")[1]
    want = data.filter("asset = 'BTC' and timestamp between 1704672000 and 1705276800").count()
    assert df.count() == want > 0


def test_append_policies(spark, tmp_path):
    schema = "seq bigint, asset string, source string, price string, decimals int, timestamp bigint"
    one = spark.createDataFrame([(1, "A", "x", "10", 8, 5), (2, "A", "x", "11", 8, 5)], schema)
    two = spark.createDataFrame([(3, "A", "x", "12", 8, 5), (4, "A", "y", "13", 8, 700000)], schema)
    for policy, want in (("first", ["10", "13"]), ("last", ["12", "13"])):
        path = str(tmp_path / policy)
        for batch in (one, two, two):
            history.sink_history_append(spark, batch, path, on_conflict=policy)
        assert [r.price for r in spark.read.parquet(path).orderBy("timestamp").collect()] == want


def test_purge_at_chunk_borders(spark, tmp_path):
    base = spark.range(0, 3 * 604800, 3600).selectExpr(
        "id seq", "'A' asset", "'x' source", "'1' price", "8 decimals", "id timestamp")
    for cutoff in (0, 604800, 604801, 2 * 604800 - 1, 3 * 604800 - 3600):
        path = str(tmp_path / str(cutoff))
        history.write_history(base, path)
        history.retention_purge(spark, path, cutoff)
        assert spark.read.parquet(path).count() == base.filter(f"timestamp >= {cutoff}").count()


def test_migration_report(spark, tmp_path):
    for folder, body in (("a", '[{"price":"1","timestamp":5},{"price":null,"timestamp":6},{"price":"2","timestamp":5}]'),
                         ("b", '[{"price":"9","timestamp":7}]')):
        os.makedirs(tmp_path / folder)
        (tmp_path / folder / "history-btc.json").write_text(body)
    (tmp_path / "b" / "history-eth.json").write_text('[{"price":"3","decimals":7,"source":"band","timestamp":1}]')
    out = str(tmp_path / "out")
    done = history.migrate_history(spark, [str(tmp_path / "a"), str(tmp_path / "b")], out)
    assert done == {"files": 2, "inserted": 2, "skipped": 2}
    rows = spark.read.parquet(out).orderBy("asset").collect()
    assert [(r.asset, int(r.price), r.decimals, r.source) for r in rows] == [("BTC", 1, 8, "unknown"), ("ETH", 3, 7, "band")]


@pytest.mark.parametrize("fmt", export.FORMATS)
def test_export_round_trip(spark, data, tmp_path, fmt):
    rows = export.export_rows(data, "ETH-USD")
    export.export_table(rows, str(tmp_path / "e"), fmt)
    back = export.read_export(spark, str(tmp_path / "e"), fmt)
    columns = ["timestamp", "price", "source", "assetPair"]
    assert back.count() == rows.count() > 0
    assert export.export_checksum(back, columns).first() == export.export_checksum(rows, columns).first()
    with pytest.raises(ValueError):
        export.export_table(rows, str(tmp_path / "f"), "xls")


def test_files_hold_100k_rows(spark, tmp_path):
    rows = spark.range(0, 250_000, 1, 1).selectExpr("id timestamp", "'1' price", "'s' source", "'A-USD' assetPair")
    export.export_table(rows, str(tmp_path / "p"), "parquet")
    found = export.export_manifest(export.read_export(spark, str(tmp_path / "p"), "parquet")).collect()
    assert sorted(r.row_count for r in found) == [50_000, 100_000, 100_000]


def test_job_keys_expire(spark):
    key = export.request_key(F.lit("csv"), F.lit("BTC-USD"), F.lit(1), F.lit(2))
    req = spark.range(2).select(key.alias("key"), F.col("id").alias("seq"), F.concat(F.lit("new"), F.col("id").cast("string")).alias("job_id"))
    ledger = spark.range(1).select(key.alias("key"), F.lit("old").alias("job_id"), F.lit(1000).cast("bigint").alias("created_ms"))
    for now, want in ((1000 + 86_400_000, ["old", "old"]), (1001 + 86_400_000, ["new0", "new0"])):
        out = export.export_idempotent(req, ledger, now_ms=F.lit(now))
        assert [r.assigned_job for r in out.orderBy("seq").collect()] == want


def split_files(df, path, parts, key="seq"):
    """Several input files in arrival order."""
    total = df.agg(F.max(key)).first()[0] + 1
    for i in range(parts):
        step = total / parts
        df.filter((F.col(key) >= i * step) & (F.col(key) < (i + 1) * step)).coalesce(1).write.mode("append").json(path)


def test_ingest_over_several_batches(spark, data, tmp_path):
    landing = str(tmp_path / "in")
    split_files(feeds.render_payloads(data), landing, 4)
    schema = "seq bigint, source string, asset string, payload string, ingest_ts bigint"
    stream = jobs.stream_ingest(jobs.read_payload_stream(spark, landing, schema, files_per_batch=1))
    for _ in range(2):
        jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = data.select("asset", "source", "timestamp").distinct()
    assert got.count() == want.count() == got.select("asset", "source", "timestamp").distinct().count()


def test_stream_replays_equal_batch(spark, data, tmp_path):
    path = str(tmp_path / "in")
    split_files(data.withColumn("price", F.col("price").cast("string")), path, 3)
    schema = "seq bigint, asset string, source string, price decimal(38,0), decimals int, timestamp bigint"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    jobs.run_available(jobs.stream_guard(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.seq, r.accepted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.seq, r.accepted) for r in sequential.guard_replay(data).select("seq", "accepted").collect()}


def test_a_key_of_a_batch_is_held_in_few_bytes():
    """Rows of one key in arrival order, out of seq order, as the guard and the feed breaker take them."""
    rows, per = 200_000, 10_000

    def frames():
        for at in range(rows - per, -1, -per):
            yield pd.DataFrame({"seq": range(at, at + per), "price": [str(10**12 + i) for i in range(at, at + per)]})

    tracemalloc.start()
    seen, wanted = 0, 0
    for seqs, prices in jobs._in_order(frames(), ["seq", "price"]):
        assert len(seqs) <= per and seqs == list(range(seen, seen + len(seqs)))
        wanted += prices == [10**12 + s for s in seqs]
        seen += len(seqs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (seen, wanted) == (rows, rows // per) and peak < 50 * rows
    wide = pd.DataFrame({"seq": [3, 1, 2], "price": [str(10**30), "7", "-" + str(10**37)]})
    assert [[int(p) for p in prices] for _, prices in jobs._in_order(iter([wide]), ["seq", "price"], 2)] == [
        [7, -(10**37)], [10**30]]


def archive_state(spark, path, cold):
    hot = {r.seq for r in spark.read.parquet(path).select("seq").collect()}
    schema = spark.read.parquet(path).drop("chunk").schema
    found = [r.seq for r in history.read_archive(spark, cold, schema).select("seq").collect()]
    assert len(found) == len(set(found))
    return hot, set(found)


@pytest.mark.parametrize("stop", ["none", "before_manifest", "before_commit", "before_delete", "while_deleting"])
def test_archive_again(spark, tmp_path, monkeypatch, stop):
    base = spark.range(0, 3 * 604800, 7200).selectExpr(
        "id seq", "'A' asset", "'x' source", "'1' price", "8 decimals", "id timestamp")
    path, cold, cutoff = str(tmp_path / "hot"), str(tmp_path / "cold"), 604800 + 5 * 7200
    history.write_history(base, path)
    every = {r.seq for r in base.collect()}

    def fail(*_):
        raise RuntimeError("lost")

    steps = {"before_manifest": (history.F, "count"), "before_commit": (history.files, "create"),
             "before_delete": (history, "_drop_rows"), "while_deleting": (history.files, "remove")}
    if stop != "none":
        with monkeypatch.context() as patch:
            patch.setattr(*steps[stop], fail)
            with pytest.raises(RuntimeError):
                history.archive_cold(spark, path, cold, cutoff=cutoff)
        if stop in ("before_manifest", "before_commit"):
            assert history.archive_files(spark, cold) is None
    for _ in range(2):
        history.archive_cold(spark, path, cold, cutoff=cutoff)
        hot, archived = archive_state(spark, path, cold)
        assert archived == {s for s in every if s < cutoff} and hot == every - archived
    late = base.filter("timestamp < 14400").withColumn("source", F.lit("late")).withColumn("seq", F.col("seq") + 10**9)
    history.sink_history_append(spark, late, path)
    history.archive_cold(spark, path, cold, cutoff=cutoff)
    hot, archived = archive_state(spark, path, cold)
    assert len(archived) == len({s for s in every if s < cutoff}) + 2 and not hot & archived
    history.archive_vacuum(spark, cold)
    assert archive_state(spark, path, cold) == (hot, archived)
    runs = set(history.committed_runs(spark, cold))
    assert {p.name[4:] for kind in ("data", "manifest") for p in (tmp_path / "cold" / kind).iterdir()} == runs


def test_archive_reads_only_files_that_overlap(spark, tmp_path):
    base = spark.range(0, 4 * 604800, 7200).selectExpr("id seq", "'A' asset", "'x' source", "'1' price", "8 decimals", "id timestamp")
    path, cold = str(tmp_path / "hot"), str(tmp_path / "cold")
    history.write_history(base, path)
    schema = base.schema
    asked = []
    read = history.read_archive

    def spy(*args, **kw):
        out = read(*args, **kw)
        asked.append(0 if out is None else len(out.inputFiles()))
        return out

    history.read_archive = spy
    try:
        for weeks in (1, 2, 3):
            history.archive_cold(spark, path, cold, cutoff=weeks * 604800, batch_rows=20)
    finally:
        history.read_archive = read
    # The first look finds nothing of the runs before; the second sees the files of its own run.
    assert asked[0::2] == [0, 0, 0] and all(n == 5 for n in asked[1::2])
    part = history.read_archive(spark, cold, schema, start=604800, end=604800 + 7200 * 3)
    assert len(part.inputFiles()) == 1 and sorted(r.seq for r in part.collect()) == [604800, 612000, 619200]
    history.archive_restore(spark, path, cold, start=604800, end=2 * 604800)
    back = {r.seq for r in spark.read.parquet(path).select("seq").collect()}
    assert back == {r.seq for r in base.collect() if 604800 <= r.seq < 2 * 604800 or r.seq >= 3 * 604800}


def test_late_rows_read_their_chunks_only(spark, tmp_path):
    base = spark.range(0, 5 * 604800, 36000).selectExpr(
        "id seq", "'A' asset", "'x' source", "'1' price", "8 decimals", "id timestamp")
    path = str(tmp_path / "h")
    history.write_history(base, path)
    late = base.filter("seq in (0, 2880000)").withColumn("source", F.lit("late"))
    df = history._not_stored(spark, late, path)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "chunk#" in plan and "IN (0,4)" in plan
    assert df.count() == 2


@pytest.mark.parametrize("fmt", export.FORMATS)
def test_export_again_replaces(spark, data, tmp_path, fmt):
    rows = export.export_rows(data, "ETH-USD")
    for _ in range(2):
        export.export_table(rows, str(tmp_path / "e"), fmt)
    assert export.read_export(spark, str(tmp_path / "e"), fmt).count() == rows.count()


@pytest.mark.parametrize("limit", [0, 1])
def test_smallest_quotas(spark, limit):
    requests = spark.createDataFrame([("k", i, 1000 * i) for i in range(130)], "key string, seq bigint, ts_ms bigint")
    limits = spark.createDataFrame([("k", limit)], "key string, limit bigint")
    out = sequential.quota_replay(requests, limits).orderBy("seq").collect()
    assert [r.seq for r in out if r.allowed] == ([0, 60, 120] if limit else [])
    assert all(r.retry_after_s is not None and 0 < r.retry_after_s <= 60 for r in out if not r.allowed)


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from pricelake import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    other = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(other)
