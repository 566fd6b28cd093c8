"""Submission ledger, registries, lookups, paging, commitments and replays."""

from __future__ import annotations

from pyspark.sql import functions as F


from pricelake.operators.chunks import running
from pricelake.operators import consensus, integrity, ledger, lookups, sequential
from pricelake.plans.inputs import (
    CALLS_SQL, REQUESTS_SQL, feed_calls, readings, requests, table, with_readings,
)
from pricelake.plans.registry import plan
from pricelake.session import materialize, scratch_path

_ROW = "seq, asset, source, CAST(price AS VARCHAR) AS price, timestamp"


def row_out(df, *extra):
    return df.select("seq", "asset", "source", F.col("price").cast("string").alias("price"), "timestamp", *extra)


def _newest(n, where="true"):
    return with_readings(f"""SELECT {_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY seq DESC) AS rn
      FROM readings) WHERE rn <= {n} AND {where}""")


@plan("price_history_cap", _newest(100))
def price_history_cap(spark, sf):
    return row_out(ledger.price_history_cap(readings(spark, sf)))


@plan("history_last_n", _newest(7))
def history_last_n(spark, sf):
    return row_out(ledger.history_last_n(readings(spark, sf), 7))


@plan("ring_buffer", _newest(200))
def ring_buffer(spark, sf):
    return row_out(ledger.ring_buffer(readings(spark, sf)))


@plan("replay_since", _newest(200, "asset IN ('BTC', 'ETH') AND seq > (SELECT max(seq) - 500 FROM readings)"))
def replay_since(spark, sf):
    df = readings(spark, sf)
    since = df.agg(F.max("seq")).first()[0] - 500
    return row_out(ledger.replay_since(df, since, ["BTC", "ETH"]))


REPUTATION_CTE = """prevs AS (SELECT *, lag(price) OVER (PARTITION BY asset ORDER BY seq) AS prev FROM readings),
acc AS (SELECT *, prev IS NULL OR prev = 0 OR (abs(CAST(price AS HUGEINT) - CAST(prev AS HUGEINT)) * 10000) // abs(CAST(prev AS HUGEINT)) <= 2000 AS accurate
        FROM prevs),
rep AS (SELECT *, count(*) OVER w AS total, CAST(sum(CASE WHEN accurate THEN 1 ELSE 0 END) OVER w AS BIGINT) AS good
        FROM acc WINDOW w AS (PARTITION BY source ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


@plan("reputation", with_readings("SELECT seq, source, accurate, total AS total_submissions, good AS accurate_submissions, good * 10000 // total AS score FROM rep", REPUTATION_CTE))
def reputation(spark, sf):
    return ledger.reputation(readings(spark, sf).select("seq", "asset", "source", "price")).select(
        "seq", "source", "accurate", "total_submissions", "accurate_submissions", "score")


@plan("reputation_decay", with_readings("""SELECT source, score, periods, decayed_score FROM (
   WITH RECURSIVE base AS (SELECT source, arg_max(good * 10000 // total, seq) AS score,
       least(40, (1719792000 - max(timestamp)) // 604800) AS periods FROM rep GROUP BY 1),
     steps AS (SELECT source, score, periods, 0 AS i, score AS s FROM base
               UNION ALL SELECT source, score, periods, i + 1, s * 95 // 100 FROM steps WHERE i < periods)
   SELECT source, score, periods, s AS decayed_score FROM steps WHERE i = periods)""", REPUTATION_CTE))
def reputation_decay(spark, sf):
    rep = ledger.reputation(readings(spark, sf).select("seq", "asset", "source", "price", "timestamp"))
    latest = rep.groupBy("source").agg(F.max_by("score", "seq").alias("score"), F.max("timestamp").alias("last_updated"))
    out = ledger.reputation_decay(latest, now=F.lit(1719792000))
    return out.select("source", "score", F.col("periods").cast("bigint").alias("periods"), "decayed_score")


STAKES = "CASE WHEN event_type IN ('error', 'view') THEN 'slash' ELSE 'stake' END"


@plan("stake_balance", f"""WITH RECURSIVE log AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS source, {STAKES} AS kind,
     CAST(round(value * 100) AS BIGINT) AS amount, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
     WHERE round(value * 100) > 0),
   r AS (SELECT source, n, seq, CASE kind WHEN 'stake' THEN amount ELSE 0 END AS balance, CASE kind WHEN 'slash' THEN 1 ELSE 0 END AS slashes
         FROM log WHERE n = 1
     UNION ALL SELECT l.source, l.n, l.seq, CASE l.kind WHEN 'stake' THEN r.balance + l.amount ELSE r.balance - least(l.amount, r.balance) END,
         r.slashes + CASE l.kind WHEN 'slash' THEN 1 ELSE 0 END FROM r JOIN log l ON l.source = r.source AND l.n = r.n + 1)
   SELECT seq, source, CAST(balance AS BIGINT) AS balance, CAST(slashes AS BIGINT) AS slash_count FROM r""")
def stake_balance(spark, sf):
    log = table(spark, sf, "events").selectExpr(
        "event_id AS seq", "CAST(user_id AS STRING) AS source", f"{STAKES} AS kind", "CAST(round(value * 100) AS BIGINT) AS amount")
    return ledger.stake_balance(log).select("seq", "source", F.col("balance").cast("bigint").alias("balance"), "slash_count")


REGISTRY_SQL = """reglog AS (SELECT event_id AS seq, 'user-' || CAST(user_id AS VARCHAR) AS source,
   CASE event_type WHEN 'signup' THEN 'add' ELSE 'remove' END AS kind, 'name-' || CAST(event_id AS VARCHAR) AS name
   FROM events WHERE event_type IN ('signup', 'error'))"""


def registry_log(spark, sf):
    return table(spark, sf, "events").filter("event_type IN ('signup', 'error')").selectExpr(
        "event_id AS seq", "'user-' || CAST(user_id AS STRING) AS source",
        "CASE event_type WHEN 'signup' THEN 'add' ELSE 'remove' END AS kind", "'name-' || CAST(event_id AS STRING) AS name")


@plan("source_registry", f"""WITH {REGISTRY_SQL}, gone AS (SELECT source, max(seq) FILTER (kind = 'remove') AS g FROM reglog GROUP BY 1)
   SELECT source, arg_min(name, seq) AS name, min(seq) AS registered_seq FROM reglog JOIN gone USING (source)
   WHERE kind = 'add' AND seq > coalesce(g, -1) GROUP BY 1""")
def source_registry(spark, sf):
    return ledger.source_registry(registry_log(spark, sf))


@plan("authorized_filter", f"""WITH {REGISTRY_SQL}, iv AS (SELECT source, kind, seq, lead(seq) OVER (PARTITION BY source ORDER BY seq) AS until FROM reglog)
   SELECT e.event_id AS seq, i.source FROM events e JOIN iv i ON i.source = 'user-' || CAST(e.user_id AS VARCHAR)
   AND e.event_id >= i.seq AND (i.until IS NULL OR e.event_id < i.until) WHERE i.kind = 'add'
   AND e.event_type NOT IN ('signup', 'error')""")
def authorized_filter(spark, sf):
    subs = table(spark, sf, "events").filter("event_type NOT IN ('signup', 'error')").selectExpr(
        "event_id AS seq", "'user-' || CAST(user_id AS STRING) AS source")
    return ledger.authorized_filter(subs, registry_log(spark, sf)).select("seq", "source")


LATEST_CTE = """latest AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER
   (PARTITION BY asset ORDER BY timestamp DESC, source, seq DESC) AS rn FROM readings) WHERE rn = 1)"""
_USD = """CASE asset WHEN 'XLM' THEN CAST(price AS HUGEINT) WHEN 'USDC' THEN CAST(100000000 AS HUGEINT)
   ELSE (CAST(price AS HUGEINT) * (SELECT CAST(price AS HUGEINT) FROM latest WHERE asset = 'XLM')) // 100000000 END"""


@plan("usd_anchors", with_readings("""SELECT CAST(max(price) FILTER (asset = 'XLM') AS VARCHAR) AS xlm_price,
   CAST(max(price) FILTER (asset = 'USDC') AS VARCHAR) AS usdc_price FROM latest""", LATEST_CTE))
def usd_anchors(spark, sf):
    out = ledger.usd_anchors(consensus.latest_per_asset(readings(spark, sf)))
    return out.select(F.col("xlm_price").cast("string").alias("xlm_price"), F.col("usdc_price").cast("string").alias("usdc_price"))


@plan("usd_price", with_readings(f"SELECT asset, CAST({_USD} AS VARCHAR) AS price_usd FROM latest", LATEST_CTE))
def usd_price(spark, sf):
    out = ledger.usd_price(consensus.latest_per_asset(readings(spark, sf)))
    return out.select("asset", F.col("price_usd").cast("string").alias("price_usd"))


@plan("onchain_price_view", with_readings(f"""SELECT asset, CAST(price AS VARCHAR) AS price, CAST({_USD} AS VARCHAR) AS price_usd,
   timestamp, source, (SELECT count(DISTINCT source) FROM readings) AS num_sources, asset IN ('XLM', 'BTC') AS is_trusted FROM latest""", LATEST_CTE))
def onchain_price_view(spark, sf):
    df = readings(spark, sf)
    out = ledger.onchain_price_view(
        consensus.latest_per_asset(df), num_sources=consensus.source_count(df).scalar(), trusted=["XLM", "BTC"])
    return out.select("asset", F.col("price").cast("string").alias("price"), F.col("price_usd").cast("string").alias("price_usd"),
                      "timestamp", "source", "num_sources", "is_trusted")


_VOTES = """votes AS (SELECT event_id AS seq, user_id % 7 AS proposal, user_id AS voter, event_type IN ('click', 'view', 'signup') AS support,
   user_id % 13 + 1 AS power, epoch_us(ts) // 1000000 AS ts FROM events),
props AS (SELECT p AS proposal, 1704067200 + p * 259200 AS voting_start, 1704067200 + p * 259200 + 604800 AS voting_end
          FROM (SELECT DISTINCT user_id % 7 AS p FROM events))"""


@plan("vote_tally", f"""WITH {_VOTES}, firsts AS (SELECT v.proposal, voter, arg_min(support, seq) AS support, arg_min(power, seq) AS power
     FROM votes v JOIN props p ON v.proposal = p.proposal AND ts >= voting_start AND ts < voting_end GROUP BY 1, 2),
   t AS (SELECT proposal, CAST(coalesce(sum(power) FILTER (support), 0) AS BIGINT) AS f,
                CAST(coalesce(sum(power) FILTER (NOT support), 0) AS BIGINT) AS a FROM props LEFT JOIN firsts USING (proposal) GROUP BY 1)
   SELECT proposal, f AS votes_for, a AS votes_against, CASE WHEN voting_end > 1705708800 THEN 'Active'
     WHEN f + a >= 100 AND f > a THEN 'Queued' ELSE 'Defeated' END AS status,
     CASE WHEN voting_end <= 1705708800 AND f + a >= 100 AND f > a THEN voting_end + 86400 END AS execution_time
   FROM t JOIN props USING (proposal)""")
def vote_tally(spark, sf):
    events = table(spark, sf, "events")
    votes = events.selectExpr(
        "event_id AS seq", "user_id % 7 AS proposal", "user_id AS voter", "event_type IN ('click', 'view', 'signup') AS support",
        "user_id % 13 + 1 AS power", "unix_timestamp(CAST(ts AS TIMESTAMP)) AS ts")
    props = events.selectExpr("user_id % 7 AS proposal").distinct().selectExpr(
        "proposal", "1704067200 + proposal * 259200 AS voting_start", "1704067200 + proposal * 259200 + 604800 AS voting_end")
    out = ledger.vote_tally(votes, props, now=F.lit(1705708800), quorum=100, timelock=86400)
    return out.select("proposal", "votes_for", "votes_against", "status", "execution_time")


@plan("batch_prices", with_readings("""SELECT w.asset, CAST(l.price AS VARCHAR) AS price, l.timestamp,
   CASE WHEN l.asset IS NULL THEN 'NOT_FOUND' END AS error
   FROM (VALUES ('BTC'), ('ETH'), ('DOGE'), ('XLM')) w(asset) LEFT JOIN latest l USING (asset)""", LATEST_CTE))
def batch_prices(spark, sf):
    out = lookups.batch_prices(consensus.latest_per_asset(readings(spark, sf)), ["btc", "eth", "doge", "XLM"])
    return out.select("asset", F.col("price").cast("string").alias("price"), "timestamp", "error")


@plan("batch_summary", with_readings("SELECT 4::BIGINT AS requested, count(*) AS found FROM latest WHERE asset IN ('BTC', 'ETH', 'XLM')", LATEST_CTE))
def batch_summary(spark, sf):
    return lookups.batch_summary(lookups.batch_prices(
        consensus.latest_per_asset(readings(spark, sf)), ["btc", "eth", "doge", "XLM"]))


@plan("fk_dims", """SELECT l_orderkey, l_linenumber, p_name AS asset, s_name AS source, round(l_extendedprice, 2) AS price
   FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size <= 40""")
def fk_dims(spark, sf):
    facts = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey AS asset_id", "l_suppkey AS source_id", "round(l_extendedprice, 2) AS price")
    parts = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS code", "p_size <= 40 AS enabled")
    supps = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS code", "true AS enabled")
    return lookups.fk_dims(facts, parts, supps).select("l_orderkey", "l_linenumber", "asset", "source", "price")


_SUBS = """clients AS (SELECT 'c' || CAST(n_nationkey AS VARCHAR) AS client FROM nation),
subs AS (SELECT 'c' || CAST(n_nationkey AS VARCHAR) AS client, CASE n_regionkey WHEN 0 THEN 'XLM' WHEN 1 THEN 'BTC' WHEN 2 THEN 'ETH'
   ELSE 'USDC' END AS asset FROM nation WHERE n_regionkey <> 4),
pairs AS (SELECT r.seq, r.asset, c.client FROM readings r, clients c WHERE NOT EXISTS (SELECT 1 FROM subs s WHERE s.client = c.client)
          OR EXISTS (SELECT 1 FROM subs s WHERE s.client = c.client AND s.asset = r.asset))"""


def subscriptions(spark, sf):
    """Nations as clients; those of one region have no subscription and get everything."""
    clients = table(spark, sf, "nation").withColumn("client", F.concat(F.lit("c"), F.col("n_nationkey").cast("string")))
    asset = F.expr("CASE n_regionkey WHEN 0 THEN 'XLM' WHEN 1 THEN 'BTC' WHEN 2 THEN 'ETH' ELSE 'USDC' END")
    return clients.select("client"), clients.filter("n_regionkey <> 4").select("client", asset.alias("asset"))


@plan("fanout_subscriptions", with_readings("SELECT seq, asset, client FROM pairs", _SUBS))
def fanout_subscriptions(spark, sf):
    updates = readings(spark, sf).select("seq", "asset")
    return lookups.fanout_subscriptions(updates, *subscriptions(spark, sf))


@plan("fanout_counts", with_readings("SELECT client, count(*) AS messages FROM pairs GROUP BY 1", _SUBS))
def fanout_counts(spark, sf):
    return lookups.fanout_counts(readings(spark, sf).select("seq", "asset"), *subscriptions(spark, sf))


_HOOK = {
    "id": "'hook-' || CAST(n_nationkey AS {text})",
    "type": "CASE n_nationkey % 2 WHEN 0 THEN 'threshold' ELSE 'interval' END",
    "asset": "CASE n_nationkey % 5 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'XLM' WHEN 3 THEN 'USDC' ELSE 'USDT' END",
    "value": "CAST(CASE n_nationkey % 2 WHEN 0 THEN 2000.0 + n_nationkey ELSE 3600000.0 * (1 + n_nationkey % 9) END AS DOUBLE)",
    "created_ms": "1704067200000 + CAST(n_nationkey AS BIGINT) * 86400000",
}
HOOKS_SQL = "hooks AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _HOOK.items()).format(text="VARCHAR") + " FROM nation)"


def hooks(spark, sf):
    """One registration per nation."""
    return table(spark, sf, "nation").selectExpr(*[f"{v} AS {k}".format(text="STRING") for k, v in _HOOK.items()])


def updates(spark, sf):
    return readings(spark, sf).withColumn("ts_ms", F.col("timestamp") * 1000)


@plan("webhook_threshold", with_readings("""SELECT id, seq, round(pct, 4) AS change_pct FROM (
   SELECT seq, asset, pt, CASE WHEN prev <> 0 THEN abs((CAST(price AS DOUBLE) - prev) / prev) * 100 END AS pct FROM (
     SELECT *, CAST(lag(price) OVER w AS DOUBLE) AS prev, lag(timestamp) OVER w * 1000 AS pt FROM readings
     WINDOW w AS (PARTITION BY asset ORDER BY seq))) u JOIN hooks h ON h.asset = u.asset AND h.type = 'threshold'
   WHERE pct >= value AND pt >= created_ms""", HOOKS_SQL))
def webhook_threshold(spark, sf):
    out = lookups.webhook_threshold(hooks(spark, sf), updates(spark, sf))
    return out.select("id", "seq", F.round("change_pct", 4).alias("change_pct"))


@plan("webhook_interval", with_readings("""SELECT id, seq, ts_ms FROM (
   WITH RECURSIVE cand AS (SELECT h.id, greatest(CAST(h.value AS BIGINT), 60000) AS wait, h.created_ms, r.asset, min(r.seq) AS seq, r.timestamp * 1000 AS ts_ms
       FROM hooks h JOIN readings r ON r.asset = h.asset AND h.type = 'interval' AND r.timestamp * 1000 >= h.created_ms GROUP BY ALL),
     fires AS (SELECT id, min(ts_ms) AS ts_ms FROM cand GROUP BY 1
               UNION ALL SELECT f.id, (SELECT min(c.ts_ms) FROM cand c WHERE c.id = f.id AND c.ts_ms >= f.ts_ms + c.wait) FROM fires f
               WHERE f.ts_ms IS NOT NULL)
   SELECT c.id, c.seq, c.ts_ms FROM fires f JOIN cand c ON c.id = f.id AND c.ts_ms = f.ts_ms)""", HOOKS_SQL))
def webhook_interval(spark, sf):
    return sequential.webhook_interval(hooks(spark, sf), updates(spark, sf)).select("id", "seq", "ts_ms")


_HIST = "SELECT {r} FROM readings WHERE asset = 'BTC' {w} ORDER BY timestamp{d}, source{d2}, seq{d} LIMIT {n}"


@plan("history_range", with_readings(_HIST.format(r=_ROW, w="AND timestamp BETWEEN 1704672000 AND 1705708800", d=" DESC", d2="", n=100)))
def history_range(spark, sf):
    return row_out(lookups.history_range(readings(spark, sf), "BTC", start=1704672000, end=1705708800))


@plan("history_cursor", with_readings(_HIST.format(
    r=_ROW, w="AND (timestamp > 1704672000 OR timestamp = 1704672000 AND source > 'band') AND timestamp <= 1705708800", d="", d2="", n=50)))
def history_cursor(spark, sf):
    return row_out(lookups.history_cursor(
        readings(spark, sf), "BTC", cursor=lookups.encode_cursor(1704672000), after_source="band", end=1705708800))


@plan("cursor_meta", with_readings("""SELECT count(*) AS count, count(*) = 50 AS has_next_page, rtrim(replace(replace(
   base64(encode('{"ts":' || CAST(max(timestamp) AS VARCHAR) || ',"dir":"asc"}')), '+', '-'), '/', '_'), '=') AS next_cursor
   FROM (SELECT * FROM readings WHERE asset = 'BTC' AND timestamp > 1704672000 ORDER BY timestamp, source, seq LIMIT 50)"""))
def cursor_meta(spark, sf):
    page = lookups.history_cursor(readings(spark, sf), "BTC", cursor=lookups.encode_cursor(1704672000), limit=50)
    return lookups.cursor_meta(page, 50)


@plan("page_offset", with_readings(f"""SELECT {_ROW} FROM readings ORDER BY timestamp, source, seq
   LIMIT 20 OFFSET (SELECT (least(201, greatest(1, (count(*) + 19) // 20)) - 1) * 20 FROM readings)"""))
def page_offset(spark, sf):
    page, _ = lookups.page_offset(
        readings(spark, sf), ["timestamp", "source", "seq"], F.floor(F.col("timestamp") / 3600), page=201)
    return row_out(page)


@plan("page_offset_meta", with_readings("""SELECT greatest(1, (count(*) + 19) // 20) AS page, CAST(20 AS BIGINT) AS limit, count(*) AS total,
   greatest(1, (count(*) + 19) // 20) AS total_pages, false AS has_next_page, count(*) > 20 AS has_prev_page FROM readings"""))
def page_offset_meta(spark, sf):
    _, meta = lookups.page_offset(
        readings(spark, sf), ["timestamp", "source", "seq"], F.floor(F.col("timestamp") / 3600), page=10**9)
    return meta


_LEAF = """leaves AS (SELECT timestamp // 3600 AS nonce, row_number() OVER (PARTITION BY timestamp // 3600 ORDER BY seq) - 1 AS leaf_index, seq,
   sha256(encode(asset) || unhex('00') || unhex(lpad(hex(CAST(price AS HUGEINT)), 32, '0')) || unhex(lpad(hex(decimals), 8, '0'))
          || unhex(lpad(hex(timestamp), 16, '0')) || encode(source)) AS leaf FROM readings)"""


def leaves(spark, sf):
    """One batch per hour, leaves numbered in arrival order."""
    entries = readings(spark, sf).withColumn("nonce", F.floor(F.col("timestamp") / 3600))
    numbered = running(entries, ["nonce"], "seq", {"leaf_index": ("sum", F.lit(1).cast("bigint"))})
    return integrity.merkle_leaf(numbered.withColumn("leaf_index", F.col("leaf_index") - 1))


@plan("merkle_leaf", with_readings("SELECT seq, nonce, leaf_index, leaf FROM leaves", _LEAF))
def merkle_leaf(spark, sf):
    return leaves(spark, sf).select("seq", "nonce", "leaf_index", F.lower(F.hex("leaf")).alias("leaf"))


# The tree by recursion: level by level, an odd last node pairs with itself.
_LEVELS = """lv AS (SELECT 0 AS level, nonce, leaf_index AS idx, leaf AS h FROM leaves
  UNION ALL SELECT level + 1, nonce, idx, sha256(unhex(h) || unhex(coalesce(nh, h))) FROM (
    SELECT level, nonce, idx // 2 AS idx, idx % 2 AS odd, h, lead(h) OVER (PARTITION BY nonce ORDER BY idx) AS nh,
           count(*) OVER (PARTITION BY nonce) AS n FROM lv) WHERE odd = 0 AND n > 1),
roots AS (SELECT nonce, arg_max(h, level) AS root, max(level) AS height FROM lv GROUP BY 1)"""


def _recursive(body, *ctes):
    return with_readings(body, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@plan("merkle_root", _recursive("SELECT nonce, root FROM roots", _LEAF, _LEVELS))
def merkle_root(spark, sf):
    return integrity.merkle_root(leaves(spark, sf)).select("nonce", F.lower(F.hex("root")).alias("root"))


@plan("merkle_proof", _recursive("""SELECT l.nonce, l.leaf_index, coalesce(string_agg(coalesce(s.h, own.h), ',' ORDER BY own.level), '') AS siblings
   FROM leaves l JOIN roots r USING (nonce)
   LEFT JOIN lv own ON own.nonce = l.nonce AND own.level < r.height AND own.idx = l.leaf_index // CAST(pow(2, own.level) AS BIGINT)
   LEFT JOIN lv s ON s.nonce = own.nonce AND s.level = own.level AND s.idx = xor(own.idx, 1) GROUP BY 1, 2""", _LEAF, _LEVELS))
def merkle_proof(spark, sf):
    out = integrity.merkle_proof(leaves(spark, sf))
    return out.select("nonce", "leaf_index",
                      F.array_join(F.transform("siblings", lambda s: F.lower(F.hex(s))), ",").alias("siblings"))


@plan("merkle_append", _recursive("""SELECT l.nonce, l.leaf_index, coalesce(string_agg(coalesce(s.h, own.h), ',' ORDER BY own.level), '') AS siblings,
     any_value(r.root) AS root
   FROM (SELECT nonce, max(leaf_index) AS leaf_index FROM leaves GROUP BY 1) l JOIN roots r USING (nonce)
   LEFT JOIN lv own ON own.nonce = l.nonce AND own.level < r.height AND own.idx = l.leaf_index // CAST(pow(2, own.level) AS BIGINT)
   LEFT JOIN lv s ON s.nonce = own.nonce AND s.level = own.level AND s.idx = xor(own.idx, 1) GROUP BY 1, 2""", _LEAF, _LEVELS))
def merkle_append(spark, sf):
    """Batches added to a stored tree table in three runs, one of them a repetition; proofs of the last leaves from it."""
    store = scratch_path(spark, "merkle")
    lv = materialize(leaves(spark, sf).select("nonce", "leaf_index", "leaf"), "leaves")
    for batch in (lv.filter("nonce % 2 = 0"), lv.filter("nonce % 2 = 0"), lv):
        integrity.merkle_append(spark, batch, store)
    last = lv.groupBy("nonce").agg(F.max("leaf_index").alias("leaf_index"))
    out = integrity.merkle_stored_proofs(spark, store, last)
    return out.select(
        "nonce", "leaf_index", F.array_join(F.transform("siblings", lambda s: F.lower(F.hex(s))), ",").alias("siblings"),
        F.lower(F.hex("root")).alias("root"))


@plan("merkle_verify", with_readings("SELECT nonce, leaf_index, leaf_index % 5 <> 3 AS valid FROM leaves", _LEAF))
def merkle_verify(spark, sf):
    """Every proof against its root; each fifth leaf is tampered with."""
    lv = materialize(leaves(spark, sf).select("nonce", "leaf_index", "leaf"), "leaves")
    forged = F.when(F.col("leaf_index") % 5 == 3, integrity.sha(F.col("leaf"))).otherwise(F.col("leaf"))
    full = integrity.merkle_proof(lv).join(lv, ["nonce", "leaf_index"]).join(integrity.merkle_root(lv), "nonce")
    return integrity.merkle_verify(full.withColumn("leaf", forged)).select("nonce", "leaf_index", "valid")


AUDIT_KEY = b"audit-demo-key"


def _hmac_sql(message: str) -> str:
    block = AUDIT_KEY.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@plan("audit_chain_verify", f"""WITH log AS (SELECT event_id AS seq, props AS json, sha256(props) AS anchor,
     lag(sha256(props)) OVER (ORDER BY event_id) AS before FROM events)
   SELECT seq, CASE WHEN seq % 2 = 0 THEN anchor ELSE {_hmac_sql('json || before')} END AS hmac, seq % 2 = 1 AS intact FROM log""")
def audit_chain_verify(spark, sf):
    """A log whose odd entries continue the chain and whose even ones break it."""
    log = table(spark, sf, "events").selectExpr("event_id AS seq", "props AS json", "sha2(props, 256) AS anchor")
    log = ledger.with_previous(log, [], "seq", "anchor")
    chained = integrity.hmac_sha256(F.concat("json", F.coalesce("prev", F.lit(""))), AUDIT_KEY)
    log = log.select("seq", "json", F.when(F.col("seq") % 2 == 0, F.col("anchor")).otherwise(chained).alias("hmac"))
    return integrity.audit_chain_verify(log, AUDIT_KEY).select("seq", "hmac", "intact")


@plan("feed_breaker", f"""WITH RECURSIVE {CALLS_SQL}, log AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM calls),
   r AS (SELECT source, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, true AS allowed, 'CLOSED' AS st, 0 AS wins, 0 AS failures,
                CAST(NULL AS BIGINT) AS failed_at, 0 AS trips FROM (SELECT DISTINCT source FROM calls)
     UNION ALL SELECT source, n, seq, mode <> 'SKIP',
       CASE WHEN mode = 'SKIP' THEN 'OPEN' WHEN mode = 'CLOSED' THEN CASE WHEN ok OR failures + 1 < 3 THEN 'CLOSED' ELSE 'OPEN' END
            WHEN NOT ok THEN 'OPEN' WHEN w + 1 >= 2 THEN 'CLOSED' ELSE 'HALF_OPEN' END,
       CASE WHEN mode = 'HALF' AND ok AND w + 1 < 2 THEN w + 1 ELSE 0 END,
       CASE WHEN mode = 'SKIP' THEN failures WHEN NOT ok THEN failures + 1 WHEN mode = 'CLOSED' OR w + 1 >= 2 THEN 0 ELSE failures END,
       CASE WHEN mode = 'SKIP' OR ok THEN failed_at ELSE ts_ms END,
       trips + CASE WHEN mode <> 'SKIP' AND NOT ok AND (mode = 'HALF' OR failures + 1 >= 3) THEN 1 ELSE 0 END
     FROM (SELECT l.source, l.n, l.seq, l.ts_ms, l.ok, r.failures, r.failed_at, r.trips,
             CASE WHEN r.st = 'HALF_OPEN' THEN r.wins ELSE 0 END AS w,
             CASE WHEN r.st = 'OPEN' AND l.ts_ms - r.failed_at < 1800000 THEN 'SKIP' WHEN r.st = 'CLOSED' THEN 'CLOSED' ELSE 'HALF' END AS mode
           FROM r JOIN log l ON l.source = r.source AND l.n = r.n + 1))
   SELECT seq, source, allowed, st AS state, CAST(failures AS BIGINT) AS failures, CAST(trips AS BIGINT) AS trips FROM r WHERE n > 0""")
def feed_breaker(spark, sf):
    out = sequential.feed_breaker(feed_calls(spark, sf), cooldown_ms=1_800_000)
    return out.select("seq", "source", "allowed", "state", "failures", "trips")


@plan("guard_replay", _recursive("SELECT seq, asset, accepted FROM r",
    "log AS (SELECT seq, asset, CAST(price AS HUGEINT) AS price, row_number() OVER (PARTITION BY asset ORDER BY seq) AS n FROM readings)",
    """r AS (SELECT asset, n, seq, price AS last, true AS accepted FROM log WHERE n = 1
     UNION ALL SELECT l.asset, l.n, l.seq, CASE WHEN r.last = 0 OR abs(l.price - r.last) * 10000 // abs(r.last) <= 5000 THEN l.price ELSE r.last END,
       r.last = 0 OR abs(l.price - r.last) * 10000 // abs(r.last) <= 5000 FROM r JOIN log l ON l.asset = r.asset AND l.n = r.n + 1)"""))
def guard_replay(spark, sf):
    out = sequential.guard_replay(readings(spark, sf), bps=5000)
    return out.select("seq", "asset", "accepted")


def quota_requests(spark, sf):
    """Requests squeezed into an eighth of their time so that limits bind."""
    req = requests(spark, sf)
    return req.select(F.concat(F.lit("key-"), (F.col("seq") % 3).cast("string")).alias("key"), "seq",
                      F.floor(F.col("timestamp") / 500).alias("ts_ms"))


@plan("quota_replay", f"""WITH RECURSIVE {REQUESTS_SQL}, limits(key, lim) AS (VALUES ('key-0', 60), ('key-1', 45), ('key-2', 500)),
   log AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n
           FROM (SELECT 'key-' || CAST(seq % 3 AS VARCHAR) AS key, seq, timestamp // 500 AS ts FROM requests) JOIN limits USING (key)),
   r AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, true AS allowed, CAST(NULL AS BIGINT) AS retry_after_s,
                CAST([] AS BIGINT[]) AS taken FROM limits
     UNION ALL SELECT key, n, seq, len(recent) < lim,
       CASE WHEN len(recent) >= lim THEN CAST(ceil((recent[1] + 60000 - ts) / 1000.0) AS BIGINT) END,
       CASE WHEN len(recent) < lim THEN list_append(recent, ts) ELSE recent END
     FROM (SELECT l.key, l.n, l.seq, l.ts, l.lim, list_filter(r.taken, lambda t: t > l.ts - 60000) AS recent
           FROM r JOIN log l ON l.key = r.key AND l.n = r.n + 1))
   SELECT key, seq, allowed, retry_after_s FROM r WHERE n > 0""")
def quota_replay(spark, sf):
    limits = spark.createDataFrame([("key-0", 60), ("key-1", 45), ("key-2", 500)], "key string, limit bigint")
    out = sequential.quota_replay(quota_requests(spark, sf), limits)
    return out.select("key", "seq", "allowed", "retry_after_s")


_DELIV = """deliv AS (SELECT event_id AS seq, 'hook-' || CAST(user_id % 20 AS VARCHAR) AS webhook_id, 1 + event_id % 5 AS attempt,
   event_type <> 'error' AS success FROM events)"""


def deliveries(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id AS seq", "'hook-' || CAST(user_id % 20 AS STRING) AS webhook_id", "1 + event_id % 5 AS attempt",
        "event_type <> 'error' AS success")


@plan("delivery_log", f"WITH {_DELIV} SELECT seq, webhook_id, attempt, success FROM deliv WHERE webhook_id = 'hook-3' ORDER BY seq DESC LIMIT 100")
def delivery_log(spark, sf):
    return lookups.delivery_log(deliveries(spark, sf), "hook-3", 100)


@plan("delivery_summary", f"""WITH {_DELIV} SELECT webhook_id, attempt, count(*) AS attempts, count(*) FILTER (success) AS delivered,
   count(*) FILTER (NOT success AND attempt >= 5) AS exhausted FROM deliv GROUP BY 1, 2""")
def delivery_summary(spark, sf):
    return lookups.delivery_summary(deliveries(spark, sf))
