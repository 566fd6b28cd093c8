"""Golden values of the specification and exactness of the column helpers."""

import base64
import hashlib
import hmac
import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pricelake.functions import decimals as D, vault
from pricelake.operators import breaker, consensus, health, integrity, ledger, lookups, quality, validate
from pricelake.sources import export, feeds

NOW = 1_719_000_000


def readings(spark, rows):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "seq bigint, asset string, source string, p string, decimals int, timestamp bigint")
    return df.selectExpr("seq", "asset", "source", "cast(p as decimal(38,0)) price", "decimals", "timestamp")


@pytest.mark.parametrize("raw,scale,want", [
    ("123", 7, 1230000000), ("65000.50", 8, 6500050000000), ("3500", 18, 3500 * 10**18), ("0.12", 8, 12000000),
    ("1.00", 8, 100000000), ("-0.125", 2, -13), ("1e-7", 8, 10), ("1.5E3", 0, 1500), (".5", 0, 1), ("0.4999", 0, 0),
    ("9" * 38, 0, 10**38 - 1), ("9" * 38, 1, None), ("3500000000000000000000", 18, None), ("abc", 1, None), ("", 1, None),
    (str(2**127 - 1), 0, None), (str(-(2**127) + 1), 0, None)])
def test_normalize(spark, raw, scale, want):
    df = spark.createDataFrame([(raw, scale)], "raw string, d int")
    got = df.select(D.shift_point(F.col("raw"), F.col("d"))).first()[0]
    assert (None if got is None else int(got)) == want


def test_payload_shapes(spark):
    rows = [
        ("chainlink", "xlm", '{"USD":{"PRICE":0.12}}'),
        ("redstone", "BTC", '{"BTC":{"value":"65000","decimals":8}}'),
        ("band", "ETH", '{"data":{"price":"3500000000000000000000","decimals":18,"updated_at":1719000000}}'),
        ("reflector", "USDC", '{"prices":{"Crypto.USDC/USD":{"price":"1.00","decimals":8,"timestamp":1718999999}}}'),
        ("band", "ETH", '{"data":{"price":"2","decimals":0}}'),
        ("chainlink", "BTC", '{"USD":{"PRICE":0}}'), ("chainlink", "BTC", '{"error":"none"}'), ("redstone", "BTC", "not json"),
    ]
    df = spark.createDataFrame([(i, *r, NOW) for i, r in enumerate(rows)],
                               "seq bigint, source string, asset string, payload string, ingest_ts bigint")
    good = {r.seq: (r.asset, int(r.price), r.decimals, r.timestamp) for r in feeds.scan_feed_payloads(df).collect()}
    assert good == {0: ("XLM", 12000000, 8, NOW), 1: ("BTC", 6500000000000, 8, NOW), 3: ("USDC", 100000000, 8, 1718999999),
                    4: ("ETH", 2 * 10**9, 9, NOW)}
    assert [(r.seq, r.reason) for r in feeds.quarantine(df).collect()] == [(2, "price_overflow")]


@pytest.mark.parametrize("rows,price,sources,level,stale,confidence", [
    ([("A", "chainlink", "100", 8, NOW), ("A", "band", "102", 8, NOW), ("A", "redstone", "101", 8, NOW)], "101.0", 3, "healthy", False, 1.0),
    ([("A", "chainlink", "100", 8, NOW), ("A", "band", "105", 8, NOW)], "102.5", 2, "healthy", False, 1.0),
    ([("A", "chainlink", "100", 8, NOW - 300), ("A", "band", "110", 8, NOW)], "110.0", 1, "degraded", False, 0.5),
    ([("A", "chainlink", "100", 8, NOW - 300)], "100.0", 1, "critical", True, 1.0),
    ([("A", "chainlink", "100", 8, NOW)], "100.0", 1, "healthy", False, 1.0),
    ([("A", "chainlink", "100", 8, NOW - 120), ("A", "band", "7", 8, NOW)], "7.0", 1, "degraded", False, 0.5),
    ([("A", "chainlink", "100", 1, NOW), ("A", "band", "1100", 2, NOW)], "1050.0", 2, "healthy", False, 1.0),
    ([("A", "chainlink", "1", 8, NOW - 9), ("A", "chainlink", "5", 8, NOW - 5)], "5.0", 1, "healthy", False, 1.0),
])
def test_consensus(spark, rows, price, sources, level, stale, confidence):
    r = consensus.consensus_price(readings(spark, rows), as_of=F.lit(NOW)).first()
    assert (str(r.price), len(r.sources), r.level, r.stale, r.confidence) == (price, sources, level, stale, confidence)


def test_consensus_leaves_suspicious_out_unless_all_are(spark):
    rows = [("A", "chainlink", "100", 8, NOW), ("A", "band", "900", 8, NOW), ("B", "band", "7", 8, NOW)]
    df = readings(spark, rows).withColumn("suspicious", F.col("source") == "band")
    got = {r.asset: (str(r.price), r.confidence) for r in consensus.consensus_price(df, as_of=F.lit(NOW)).collect()}
    assert got == {"A": ("100.0", 0.5), "B": ("7.0", 1.0)}


@pytest.mark.parametrize("ranked_rows", [2_000_000, 400, 7])
def test_exact_median(spark, ranked_rows):
    rng = random.Random(8)
    data = {"hot": [rng.choice([5, rng.randint(-10**20, 10**20)]) for _ in range(4001)], "one": [3], "two": [1, 2],
            "same": [9] * 500, "wide": [10**36 + i for i in range(300)]}
    df = spark.createDataFrame([(k, str(v)) for k, vs in data.items() for v in vs], "k string, v string")
    df = df.selectExpr("k", "cast(v as decimal(38,0)) v")
    got = {r.k: r.median for r in consensus.exact_median(df, ["k"], "v", ranked_rows=ranked_rows, bins=20).collect()}
    for k, vs in data.items():
        vs.sort()
        assert Fraction(got[k]) == Fraction(vs[(len(vs) - 1) // 2] + vs[len(vs) // 2], 2), k


def test_rescale(spark):
    df = spark.createDataFrame([("15", 1, 0), ("-15", 1, 0), ("14", 1, 0), ("7", 0, 3), (str(10**37), 0, 5)], "p string, a int, b int")
    got = [r[0] for r in df.select(D.rescale(F.col("p").cast("decimal(38,0)"), F.col("a"), F.col("b"))).collect()]
    assert got == [2, -2, 1, 7000, None]


def test_bps(spark):
    cases = [("110", "100", 1000), ("-5", "5", 20000), ("5", "0", None), ("0", "7", 10000), ("9" * 38, "1", None)]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string").selectExpr("cast(a as decimal(38,0)) a", "cast(b as decimal(38,0)) b")
    got = [r[0] for r in df.select(D.deviation_bps(F.col("a"), F.col("b"))).collect()]
    assert got == [c[2] for c in cases]


def test_decay(spark):
    df = spark.createDataFrame([(10000, 0), (10000, 604800 * 39), (10000, 604800 * 40 - 1), (7, 604800 * 40)], "score bigint, last_updated bigint")
    got = [r.decayed_score for r in ledger.reputation_decay(df, now=F.lit(604800 * 40)).orderBy("last_updated", "score").collect()]
    assert got == [1278, 9500, 10000, 7]


def test_usd_needs_anchors(spark):
    rows = [("XLM", "band", "2", 7, NOW), ("BTC", "band", "9", 7, NOW)]
    got = {r.asset: r.price_usd for r in ledger.usd_price(readings(spark, rows)).collect()}
    assert got == {"XLM": 2, "BTC": None}
    rows += [("USDC", "band", "1", 1, NOW), ("DOGE", "band", "-17", 7, NOW)]
    got = {r.asset: r.price_usd for r in ledger.usd_price(readings(spark, rows)).collect()}
    assert got == {"XLM": 2, "BTC": 1, "USDC": 10, "DOGE": -3}


def test_history_limits(spark):
    df = readings(spark, [("A", "band", str(10000 * (i + 1)), 8, NOW + i) for i in range(20)])
    assert ledger.history_last_n(df, 1).first().price == 200000
    assert [ledger.history_last_n(df, n).count() for n in (0, 3, 100)] == [0, 3, 20]


def leaf(asset, price, scale, ts, source):
    return hashlib.sha256(asset.encode() + b"\0" + price.to_bytes(16, "big", signed=True) + scale.to_bytes(4, "big")
                          + ts.to_bytes(8, "big") + source.encode()).digest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([hashlib.sha256(row[i] + row[min(i + 1, len(row) - 1)]).digest() for i in range(0, len(row), 2)])
    return levels


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1024, 1025, 2500])
def test_merkle(spark, n):
    rng = random.Random(n)
    rows = [("A", "band", str(rng.randint(-(10**38) + 1, 10**38 - 1)), 8, NOW + i) for i in range(n)]
    df = integrity.merkle_leaf(readings(spark, rows).withColumn("nonce", F.lit(1)).withColumnRenamed("seq", "leaf_index")).cache()
    want = [leaf(a, int(p), d, t, s) for a, s, p, d, t in rows]
    assert [bytes(r.leaf) for r in df.orderBy("leaf_index").collect()] == want
    levels = tree(want)
    assert bytes(integrity.merkle_root(df).first().root) == levels[-1][0]
    proofs = integrity.merkle_proof(df)
    for r in proofs.collect():
        i, path = r.leaf_index, []
        for row in levels[:-1]:
            path.append(row[i ^ 1] if (i ^ 1) < len(row) else row[i])
            i //= 2
        assert [bytes(s) for s in r.siblings] == path
    full = proofs.join(df.select("nonce", "leaf_index", "leaf"), ["nonce", "leaf_index"]).withColumn("root", F.lit(levels[-1][0]))
    assert integrity.merkle_verify(full).filter("valid").count() == n


@pytest.mark.parametrize("size", [2, 1000])
def test_audit_chain(spark, size):
    key, prev, rows = b"k" * 70, "", []
    for i in range(40):
        body = json.dumps({"event": i})
        prev = hmac.new(key, (body + prev).encode(), "sha256").hexdigest()
        rows.append((i * 2, body, prev))
    rows[17] = (34, '{"event": "forged"}', rows[17][2])
    df = spark.createDataFrame(rows, "seq bigint, json string, hmac string")
    assert [r.seq for r in integrity.audit_chain_verify(df, key, size).filter("not intact").collect()] == [34]


def test_stored_trees(spark, tmp_path):
    """Trees of one and of several blocks, added in two runs: nodes, single and joined proofs, and untouched files."""
    sizes = {1: 1, 2: 2, 3: 5, 4: 1024, 5: 1025, 6: 2500, 7: 37}
    leaf = lambda nonce, i: hashlib.sha256(f"{nonce}:{i}".encode()).digest()
    rows = [(n, i, bytearray(leaf(n, i))) for n, size in sizes.items() for i in range(size)]
    df = spark.createDataFrame(rows, "nonce bigint, leaf_index bigint, leaf binary").repartition(3)
    trees = {n: tree([leaf(n, i) for i in range(size)]) for n, size in sizes.items()}
    store = str(tmp_path / "store")
    assert integrity.merkle_roots(spark, store) is None
    integrity.merkle_append(spark, df.filter("nonce < 6"), store)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "store").glob("*.parquet")}
    for _ in range(2):
        integrity.merkle_append(spark, df, store)
    after = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "store").glob("*.parquet")}
    assert before.items() <= after.items()
    stored = sorted((r.nonce, r.level, r.idx, bytes(r.hash)) for r in spark.read.parquet(store).collect())
    assert stored == sorted((n, k, i, h) for n, levels in trees.items() for k, row in enumerate(levels) for i, h in enumerate(row))
    roots = {r.nonce: (bytes(r.root), r.height) for r in integrity.merkle_roots(spark, store).collect()}
    assert roots == {n: (levels[-1][0], len(levels) - 1) for n, levels in trees.items()}

    def path(n, i):
        return [row[i >> k ^ 1] if (i >> k ^ 1) < len(row) else row[i >> k] for k, row in enumerate(trees[n][:-1])]

    for n, i in ((1, 0), (3, 4), (5, 1024), (6, 2499), (6, 1023)):
        assert integrity.merkle_stored_proof(spark, store, n, i) == path(n, i)
    wanted = df.filter("leaf_index % 50 = 4 OR leaf_index = 0").select("nonce", "leaf_index")
    got = integrity.merkle_stored_proofs(spark, store, wanted).collect()
    assert len(got) == wanted.count()
    assert all([bytes(x) for x in r.siblings] == path(r.nonce, r.leaf_index) and bytes(r.root) == trees[r.nonce][-1][0] for r in got)


OLD, NEW = b"o" * 32, b"n" * 32


def key_table(spark, path, source, count=1):
    vault.create_keys(spark, source, count).write.mode("overwrite").parquet(path)
    return spark.read.schema(vault.KEY_TABLE).parquet(path)


def test_vault(spark, tmp_path):
    keys = key_table(spark, str(tmp_path / "keys"), lambda: [OLD], 3)
    a, b, c = sorted(r.key_id for r in keys.collect())
    df = spark.createDataFrame([(1, "12.5"), (2, None), (3, "a:b")], "i int, v string")
    sealed = vault.encrypt(df, "v", keys, lambda: [OLD], a)
    assert sealed.columns == df.columns
    assert vault.decrypt(sealed, "v", keys, lambda: [NEW, OLD]).orderBy("i").collect() == df.collect()
    assert sealed.filter("i = 1").first().v.split(":")[:3] == ["enc", "v1", a]
    for call in (lambda: vault.decrypt(sealed, "v", keys.filter(F.col("key_id") != a), lambda: [OLD]),
                 lambda: vault.decrypt(sealed, "v", keys, lambda: [NEW]),
                 lambda: vault.encrypt(df, "v", keys, lambda: [OLD], "00000000"),
                 lambda: vault.rewrap(keys, lambda: [NEW])):
        with pytest.raises(Exception, match="no key|no master key"):
            call().collect()

    path = str(tmp_path / "sealed")
    vault.encrypt(df, "v", keys, lambda: [OLD], a).write.parquet(path)
    stored = spark.read.schema("i int, v string").parquet(path)
    again = key_table_rewrapped(spark, keys, str(tmp_path / "rewrapped"))
    assert {r.key_id for r in again.collect()} == {a, b, c}
    assert vault.decrypt(stored, "v", again, lambda: [NEW]).orderBy("i").collect() == df.collect()
    moved = vault.rotate(stored, "v", again, lambda: [NEW], b).orderBy("i").collect()
    assert [r.v and r.v.split(":")[2] for r in moved] == [b, None, b]
    kept = vault.rotate(stored, "v", again, lambda: [NEW], a).orderBy("i").collect()
    assert kept == stored.orderBy("i").collect()


def key_table_rewrapped(spark, keys, path):
    vault.rewrap(keys, lambda: [NEW, OLD]).write.parquet(path)
    return spark.read.schema(vault.KEY_TABLE).parquet(path)


LOGGED = """
import sys
sys.path.insert(0, {root!r})
from pricelake import build_session
from pricelake.functions import vault
spark = build_session("log", master="local[2]", spark__eventLog__enabled="true", spark__eventLog__dir={log!r},
                      spark__eventLog__compress="false", spark__sql__shuffle__partitions="2", spark__sql__maxPlanStringLength="10000000")
source = lambda: [bytes.fromhex(open({secret!r}).read())]
vault.create_keys(spark, source, 1).write.parquet({base!r} + "/keys")
keys = spark.read.schema(vault.KEY_TABLE).parquet({base!r} + "/keys")
name = keys.first().key_id
vault.encrypt(spark.range(50).selectExpr("id", "CAST(id AS STRING) AS v"), "v", keys, source, name).write.parquet({base!r} + "/out")
out = vault.decrypt(spark.read.parquet({base!r} + "/out"), "v", keys, source)
out.explain("extended")
assert out.count() == 50
vault.rewrap(keys, source).write.parquet({base!r} + "/keys2")
opened = vault.open_keys(keys, source).first().key
spark.stop()
open({base!r} + "/data-key", "wb").write(opened)
"""


def test_no_key_in_plans_or_event_log(tmp_path):
    import base64
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "log").mkdir()
    master = os.urandom(32)
    (tmp_path / "secret").write_text(master.hex())
    code = LOGGED.format(root=root, log=f"file://{tmp_path}/log", secret=str(tmp_path / "secret"), base=str(tmp_path))
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    said = ran.stdout + "".join(f.read_text() for f in (tmp_path / "log").rglob("*") if f.is_file() and not f.name.endswith(".crc"))
    assert "MapInPandas" in said and len(said) > 10_000
    for key in (master, (tmp_path / "data-key").read_bytes()):
        forms = (key.hex(), key.hex().upper(), base64.b64encode(key).decode(), ", ".join(str(x) for x in key), str(list(key))[1:-1],
                 " ".join(f"{x:02X}" for x in key))
        assert not [f for f in forms if f in said]


def test_cursor():
    text = lookups.encode_cursor(1719000000)
    assert json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))) == {"ts": 1719000000, "dir": "asc"}
    assert lookups.decode_cursor(text) == 1719000000
    assert [lookups.decode_cursor(c) for c in ("junk", "", None, base64.b64encode(b'{"ts":"x"}').decode())] == [None] * 4


def test_pages(spark):
    df = spark.range(45).withColumnRenamed("id", "seq")
    seen = []
    for page in range(1, 8):
        rows, meta = lookups.page_offset(df, ["seq"], F.floor(F.col("seq") / 7), page=page, limit=10)
        m = meta.first()
        if page <= 5:
            seen += [r.seq for r in rows.collect()]
        assert (m.page, m.total_pages, m.has_next_page, m.has_prev_page) == (min(page, 5), 5, page < 5, page > 1)
    assert seen == list(range(45))


def test_asset_lists(spark):
    df = spark.createDataFrame([(["BTC", "ETH"],), ([],), (["btc"],), (["A"] * 51,)], "a array<string>")
    assert [r[0] for r in df.select(validate.asset_list_valid(F.col("a"))).collect()] == [True, False, False, False]


def test_quality_ok(spark):
    df = readings(spark, [("A", "band", "1", 8, NOW)])
    found = quality.quality_violations(df, df, df, now=F.lit(NOW))
    assert {r.layer: r.status for r in quality.quality_report(found).collect()} == {"db-integrity": "ok", "feed-store": "ok"}


def test_long_signed_number(spark):
    zeros = "0" * 6000
    rows = [("-1." + zeros + "e3", "-1000"), ("1." + zeros + "e3", "1000"), ("+1" + "0" * 5999 + "e-5999", "1")]
    df = spark.createDataFrame(rows, "raw string, want string")
    for r in df.select(D.shift_point(F.col("raw"), F.lit(0)).alias("got"), "want").collect():
        assert str(r.got) == r.want


def test_source_outside_the_known_feeds_counts(spark):
    rows = [("A", "chainlink", "100", 8, NOW), ("A", "fifth", "300", 8, NOW + 1), ("A", "sixth", "200", 8, NOW + 2)]
    out = breaker.breaker_state(readings(spark, rows), scale=8).orderBy("seq").collect()
    assert [str(r.median) for r in out] == ["100.0", "200.0", "200.0"]


def test_uptime_without_checks(spark):
    rows = [("a", 1, "degraded", False), ("b", 2, "check", True), ("b", 3, "check", False)]
    df = spark.createDataFrame(rows, "component string, seq bigint, kind string, ok boolean")
    assert {r.component: r.uptime_pct for r in health.uptime_pct(df).collect()} == {"a": 100.0, "b": 50.0}


def test_text_that_only_looks_sealed_passes(spark):
    df = spark.createDataFrame([("enc:note",), ("enc:",), ("plain",), (None,)], "v string")
    none = spark.createDataFrame([], vault.KEY_TABLE)
    assert [r[0] for r in vault.decrypt(df, "v", none, lambda: [bytes(32)]).collect()] == ["enc:note", "enc:", "plain", None]


def test_digest_tells_cells_apart(spark):
    digest = lambda a, b: export.export_checksum(
        spark.createDataFrame([(a, b)], "a string, b string"), ["a", "b"]).first().checksum
    assert len({digest("a,b", "c"), digest("a", "b,c"), digest(None, "c"), digest("-", "c"), digest("\\N", "c")}) == 5
