"""Scans, sinks, archive, exports, encryption and validation over the event table."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from pricelake.functions import vault
from pricelake.operators import validate
from pricelake.plans.inputs import as_of, readings, with_readings, table
from pricelake.plans.registry import plan
from pricelake.session import scratch_path
from pricelake.sources import export, feeds, history

START, END = 1704672000, 1705708800
CUTOFF = 1705276800 + 4321

_READING_COLUMNS = "seq, asset, source, CAST(price AS VARCHAR) AS price, CAST(decimals AS BIGINT) AS decimals, timestamp"


def reading_out(df, *extra):
    return df.select("seq", "asset", "source", F.col("price").cast("string").alias("price"),
                     F.col("decimals").cast("bigint").alias("decimals"), "timestamp", *extra)


@plan("scan_feed_payloads", with_readings(f"SELECT {_READING_COLUMNS} FROM readings WHERE price <> 0"))
def scan_feed_payloads(spark, sf):
    """Readings rendered as payload texts, landed as JSON lines, parsed back."""
    path = scratch_path(spark, "landing")
    feeds.render_payloads(readings(spark, sf)).write.json(path)
    landed = spark.read.schema("seq bigint, source string, asset string, payload string, ingest_ts bigint").json(path)
    return reading_out(feeds.scan_feed_payloads(landed))


@plan("feed_quarantine", with_readings("""SELECT seq, source, asset, CASE seq % 5 WHEN 0 THEN 'price_overflow' ELSE 'not_a_number' END AS reason
   FROM readings WHERE seq % 5 < 2"""))
def feed_quarantine(spark, sf):
    """Payloads of all feeds, two in five with a price that no feed can mean."""
    rows = feeds.render_payloads(readings(spark, sf))
    bad = F.when(F.col("seq") % 5 == 0, "9e40").when(F.col("seq") % 5 == 1, "n/a")
    spoilt = F.regexp_replace("payload", F.lit('"(PRICE|value|price)":"?[-0-9.]+"?'), F.concat(F.lit('"$1":"'), bad, F.lit('"')))
    return feeds.quarantine(rows.withColumn("payload", F.coalesce(spoilt, "payload"))).select("seq", "source", "asset", "reason")


@plan("symbol_map", with_readings("""SELECT DISTINCT source, asset, CASE source WHEN 'chainlink' THEN asset
   WHEN 'redstone' THEN asset WHEN 'band' THEN CASE asset WHEN 'XLM' THEN 'XLM' ELSE asset || '-USD' END
   ELSE 'Crypto.' || asset || '/USD' END AS symbol FROM readings"""))
def symbol_map(spark, sf):
    pairs = readings(spark, sf).select("asset", "source").distinct()
    return feeds.symbol_map(pairs).select("source", "asset", "symbol")


@plan("scan_history_json", with_readings(
    "SELECT asset, CAST(price AS VARCHAR) AS price, CAST(decimals AS BIGINT) AS decimals, source, timestamp FROM readings"))
def scan_history_json(spark, sf):
    path = scratch_path(spark, "history-json")
    history.write_history_json(readings(spark, sf), path)
    out = history.scan_history_json(spark, f"{path}/*", multi_line=False)
    return out.select("asset", "price", F.col("decimals").cast("bigint").alias("decimals"), "source", "timestamp")


@plan("scan_history_table", with_readings(
    f"SELECT {_READING_COLUMNS} FROM readings WHERE asset = 'BTC' AND timestamp BETWEEN {START} AND {END}"))
def scan_history_table(spark, sf):
    path = scratch_path(spark, "history")
    history.write_history(readings(spark, sf), path)
    return reading_out(history.scan_history_table(spark, path, asset="BTC", start=START, end=END))


def _dup_batches(spark, sf):
    """Two overlapping arrivals: hours collapse many readings onto one key."""
    df = readings(spark, sf).withColumn("timestamp", F.floor(F.col("timestamp") / 3600) * 3600)
    return df.filter(F.col("seq") % 2 == 0), df.filter(F.col("seq") % 2 == 1)


_HOURLY = "hourly AS (SELECT *, timestamp // 3600 * 3600 AS hour FROM readings)"
_APPENDED = f"""SELECT seq, asset, source, CAST(price AS VARCHAR) AS price, CAST(decimals AS BIGINT) AS decimals,
   hour AS timestamp FROM (SELECT *, row_number() OVER (PARTITION BY asset, source, hour ORDER BY {{o}}) AS rn
   FROM hourly) WHERE rn = 1"""


@plan("sink_history_append", with_readings(_APPENDED.format(o="seq % 2, seq"), _HOURLY))
def sink_history_append(spark, sf):
    even, odd = _dup_batches(spark, sf)
    path = scratch_path(spark, "append")
    history.sink_history_append(spark, even, path)
    history.sink_history_append(spark, odd, path)
    return reading_out(spark.read.parquet(path))


@plan("sink_history_append_last", with_readings(_APPENDED.format(o="seq % 2 DESC, seq DESC"), _HOURLY))
def sink_history_append_last(spark, sf):
    even, odd = _dup_batches(spark, sf)
    path = scratch_path(spark, "append-last")
    history.sink_history_append(spark, even, path, on_conflict="last")
    history.sink_history_append(spark, odd, path, on_conflict="last")
    return reading_out(spark.read.parquet(path))


@plan("dedupe_readings", with_readings(_APPENDED.format(o="seq"), _HOURLY))
def dedupe_readings(spark, sf):
    df = readings(spark, sf).withColumn("timestamp", F.floor(F.col("timestamp") / 3600) * 3600)
    return reading_out(history.dedupe_readings(df))


@plan("upsert_state", with_readings("""SELECT asset, CAST(price AS VARCHAR) AS latest_price, timestamp AS latest_timestamp
   FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY timestamp DESC, seq % 2 DESC, seq DESC) AS rn FROM readings)
   WHERE rn = 1"""))
def upsert_state(spark, sf):
    def state(df):
        key = F.struct("timestamp", "seq")
        return df.groupBy("asset").agg(F.max_by(F.col("price").cast("string"), key).alias("latest_price"),
                                       F.max("timestamp").alias("latest_timestamp"))

    df = readings(spark, sf)
    return history.upsert_state(state(df.filter("seq % 2 = 0")), state(df.filter("seq % 2 = 1")))


@plan("archive_cold", with_readings(f"""SELECT {_READING_COLUMNS}, timestamp < {CUTOFF} AS cold FROM readings"""))
def archive_cold(spark, sf):
    """Cold and hot part after the archive run, told apart by a flag."""
    path, cold = scratch_path(spark, "hot"), scratch_path(spark, "cold")
    history.write_history(readings(spark, sf), path)
    schema = readings(spark, sf).schema
    history.archive_cold(spark, path, cold, cutoff=CUTOFF)
    hot = spark.read.parquet(path).drop("chunk").withColumn("cold", F.lit(False))
    archived = history.read_archive(spark, cold, schema).withColumn("cold", F.lit(True))
    return reading_out(hot.unionByName(archived), "cold")


@plan("archive_cold_retry", with_readings(f"""SELECT {_READING_COLUMNS}, timestamp < {CUTOFF} AS cold FROM readings"""))
def archive_cold_retry(spark, sf):
    """The archive run twice with the same cutoff: nothing is lost, nothing is there twice."""
    path, cold = scratch_path(spark, "hot"), scratch_path(spark, "cold")
    history.write_history(readings(spark, sf), path)
    for _ in range(2):
        history.archive_cold(spark, path, cold, cutoff=CUTOFF)
    hot = spark.read.parquet(path).drop("chunk").withColumn("cold", F.lit(False))
    archived = history.read_archive(spark, cold, readings(spark, sf).schema).withColumn("cold", F.lit(True))
    return reading_out(hot.unionByName(archived), "cold")


@plan("archive_dry_run", with_readings("""SELECT count(*) FILTER (timestamp < (SELECT t FROM newest) - 7 * 86400) AS archived,
   count(*) FILTER (timestamp < (SELECT t FROM newest) - 21 * 86400) AS purged FROM readings"""))
def archive_dry_run(spark, sf):
    df = readings(spark, sf)
    return history.archive_dry_run(df, now=as_of(df), archive_days=7, retention_days=21)


@plan("archive_restore", with_readings(f"""SELECT {_READING_COLUMNS} FROM readings QUALIFY timestamp >= {CUTOFF}
   OR row_number() OVER (PARTITION BY asset, source, timestamp ORDER BY seq) = 1"""))
def archive_restore(spark, sf):
    """Archive, then restore twice: the table is whole again, without duplicates."""
    path, cold = scratch_path(spark, "hot"), scratch_path(spark, "cold")
    history.write_history(readings(spark, sf), path)
    history.archive_cold(spark, path, cold, cutoff=CUTOFF)
    for _ in range(2):
        history.archive_restore(spark, path, cold)
    return reading_out(spark.read.parquet(path))


@plan("archive_files", with_readings(
    f"""SELECT count(*) AS rows, min(timestamp) AS min_timestamp, max(timestamp) AS max_timestamp, min(asset) AS min_asset, max(asset) AS max_asset,
      true AS bounded, true AS ranges_hold FROM readings WHERE timestamp < {CUTOFF}"""))
def archive_files(spark, sf):
    """The archive's manifest: what it says of its files, held against the files."""
    path, cold = scratch_path(spark, "hot"), scratch_path(spark, "cold")
    history.write_history(readings(spark, sf), path)
    history.archive_cold(spark, path, cold, cutoff=CUTOFF, batch_rows=500)
    listed = history.archive_files(spark, cold)
    rows = history.read_archive(spark, cold, readings(spark, sf).schema)
    found = rows.groupBy(F.regexp_extract("_metadata.file_path", "run=.*", 0).alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    both = listed.join(found, "file", "full")
    same = (F.col("rows") == F.col("n")) & (F.col("min_timestamp") == F.col("a")) & (F.col("max_timestamp") == F.col("b"))
    return both.agg(
        F.sum("rows").alias("rows"), F.min("min_timestamp").alias("min_timestamp"), F.max("max_timestamp").alias("max_timestamp"),
        F.min("min_asset").alias("min_asset"), F.max("max_asset").alias("max_asset"), F.bool_and(F.col("rows") <= 500).alias("bounded"),
        F.bool_and(F.coalesce(same, F.lit(False))).alias("ranges_hold"))


@plan("retention_purge", with_readings(f"SELECT {_READING_COLUMNS} FROM readings WHERE timestamp >= {CUTOFF}"))
def retention_purge(spark, sf):
    path = scratch_path(spark, "purge")
    history.write_history(readings(spark, sf), path)
    history.retention_purge(spark, path, CUTOFF)
    return reading_out(spark.read.parquet(path))


@plan("retention_purge_created", with_readings(f"""SELECT {_READING_COLUMNS} FROM readings
   WHERE NOT (seq % 5 <> 0 AND timestamp + seq % 3 * 86400 < {CUTOFF})"""))
def retention_purge_created(spark, sf):
    """Rows come in up to two days late; every fifth has no time of storage and stays."""
    path = scratch_path(spark, "purge-created")
    stored = F.when(F.col("seq") % 5 != 0, F.timestamp_seconds(F.col("timestamp") + F.col("seq") % 3 * 86400))
    history.write_history(readings(spark, sf).withColumn("created_at", stored), path)
    history.retention_purge_created(spark, path, F.timestamp_seconds(F.lit(CUTOFF)))
    return reading_out(spark.read.parquet(path))


@plan("semi_delete", with_readings(f"SELECT {_READING_COLUMNS} FROM readings WHERE NOT (asset = 'BTC' AND timestamp < {CUTOFF})"))
def semi_delete(spark, sf):
    df = readings(spark, sf)
    gone = df.filter((F.col("asset") == "BTC") & (F.col("timestamp") < CUTOFF))
    return reading_out(history.semi_delete(df, gone, ("seq", "timestamp")))


@plan("migrate_history", with_readings("""SELECT asset, CAST(min(price + CASE WHEN asset IN ('BTC', 'ETH') THEN 0 ELSE 1 END) AS VARCHAR) AS price,
   CAST(8 AS BIGINT) AS decimals, CASE WHEN seq % 5 = 0 THEN 'unknown' ELSE source END AS source, timestamp FROM readings
   WHERE seq % 7 <> 0 GROUP BY ALL"""))
def migrate_history(spark, sf):
    """BTC and ETH exist in both folders (the first wins), the others in the second.

    Some points lack a source (unknown), some a price (skipped), all the scale.
    """
    df = readings(spark, sf).withColumns({
        "source": F.when(F.col("seq") % 5 != 0, F.col("source")),
        "price": F.when(F.col("seq") % 7 != 0, F.col("price")),
        "decimals": F.lit(None).cast("int"),
    })
    one, two, out = (scratch_path(spark, n) for n in ("migrate-a", "migrate-b", "migrated"))
    history.write_history_json(df.filter(F.col("asset").isin("BTC", "ETH")), one)
    history.write_history_json(df.withColumn("price", F.col("price") + 1), two)
    history.migrate_history(spark, [one, two], out, multi_line=False)
    done = spark.read.parquet(out)
    return done.select("asset", F.col("price").cast("string").alias("price"),
                       F.col("decimals").cast("bigint").alias("decimals"), "source", "timestamp")


_EXPORT = with_readings("""SELECT timestamp, CAST(price AS VARCHAR) AS price, source, 'BTC-USD' AS "assetPair" FROM readings
   WHERE asset = 'BTC' AND timestamp BETWEEN 1704672000 AND 1705708800""")


def _export(fmt):
    def run(spark, sf):
        path = scratch_path(spark, f"export-{fmt}")
        export.export_table(export.export_rows(readings(spark, sf), "BTC-USD", START, END), path, fmt,
                            compression="gzip" if fmt == "ndjson" else None)
        return export.read_export(spark, path, fmt)

    return run


for _fmt, _name in (("csv", "export_csv"), ("ndjson", "export_ndjson"), ("parquet", "export_parquet"),
                    ("arrow_ipc", "export_arrow")):
    plan(_name, _EXPORT)(_export(_fmt))


def all_rows(spark, sf):
    """Every reading as an export row of its own pair."""
    return readings(spark, sf).select(
        "timestamp", F.col("price").cast("string").alias("price"), "source",
        F.concat("asset", F.lit("-USD")).alias("assetPair"))


@plan("export_manifest", with_readings("""SELECT min(timestamp) AS min_timestamp, max(timestamp) AS max_timestamp,
   count(*) AS row_count, 'timestamp=int64,price=utf8,source=utf8,assetPair=utf8' AS schema FROM readings"""))
def export_manifest(spark, sf):
    """Manifest of a whole-table export, folded over its files."""
    path = scratch_path(spark, "manifest")
    export.export_table(all_rows(spark, sf), path, "parquet")
    entries = F.transform(F.map_entries("schema"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    files = export.export_manifest(export.read_export(spark, path, "parquet"))
    return files.withColumn("schema", F.array_join(entries, ",")).groupBy("schema").agg(
        F.min("min_timestamp").alias("min_timestamp"), F.max("max_timestamp").alias("max_timestamp"),
        F.sum("row_count").alias("row_count"))


_PART = "sum(CAST('0x' || substr(h, {start}, 15) AS BIGINT))"


@plan("export_checksum", with_readings("SELECT sha256(CAST(rows AS VARCHAR) || ':' || " + " || ':' || ".join(
    f"CAST(p{i} AS VARCHAR)" for i in range(4)) + ") AS checksum, rows FROM parts",
    "lines AS (SELECT sha256(array_to_string(list_transform([timestamp::VARCHAR, price::VARCHAR, source, asset || '-USD'], "
    "lambda v: length(v) || ':' || v), ',')) AS h FROM readings)",
    "parts AS (SELECT count(*) AS rows, " + ", ".join(
        f"{_PART.format(start=1 + 15 * i)} AS p{i}" for i in range(4)) + " FROM lines)"))
def export_checksum(spark, sf):
    return export.export_checksum(all_rows(spark, sf), ["timestamp", "price", "source", "assetPair"])


_JOBS = """jobs AS (SELECT seq, 'job-' || CAST(seq AS VARCHAR) AS job_id, timestamp * 1000 AS created_ms,
  sha256('{"format":"' || CASE source WHEN 'band' THEN 'csv' ELSE 'parquet' END || '","assetPair":"' || asset || '-USD","startTime":'
  || CAST(timestamp // 86400 * 86400 % 604800 AS VARCHAR) || ',"endTime":' || CAST(timestamp // 86400 * 86400 AS VARCHAR) || '}') AS key
  FROM readings)"""


@plan("export_idempotent", with_readings("""SELECT r.seq, coalesce(l.job_id, f.job_id) AS assigned_job,
     (l.job_id IS NULL AND r.seq = f.seq) AS is_new
   FROM jobs r JOIN (SELECT key, min(seq) AS seq, arg_min(job_id, seq) AS job_id FROM jobs WHERE seq % 2 = 1 GROUP BY 1) f USING (key)
   LEFT JOIN (SELECT key, arg_max(job_id, created_ms) AS job_id FROM jobs WHERE seq % 2 = 0
              AND (SELECT t FROM newest) * 1000 <= created_ms + 86400000 GROUP BY 1) l USING (key)
   WHERE r.seq % 2 = 1""", _JOBS))
def export_idempotent(spark, sf):
    df = readings(spark, sf)
    day = F.floor(F.col("timestamp") / 86400) * 86400
    fmt = F.when(F.col("source") == "band", "csv").otherwise("parquet")
    jobs = df.select(
        "seq", F.concat(F.lit("job-"), F.col("seq").cast("string")).alias("job_id"),
        (F.col("timestamp") * 1000).alias("created_ms"),
        export.request_key(fmt, F.concat("asset", F.lit("-USD")), day % 604800, day).alias("key"))
    now = (as_of(df) * 1000)
    out = export.export_idempotent(jobs.filter("seq % 2 = 1").drop("created_ms"), jobs.filter("seq % 2 = 0"), now_ms=now)
    return out.select("seq", "assigned_job", "is_new")




def master_keys(*texts):
    """A source of master keys, the first one active; a deployment would read them from a secret store."""
    return lambda: [hashlib.sha256(t.encode()).digest() for t in texts]


OLD_MASTER, NEW_MASTER = "master of last year", "master of this year"


def stored_keys(spark, source, count):
    path = scratch_path(spark, "keys")
    vault.create_keys(spark, source, count).write.parquet(path)
    return spark.read.schema(vault.KEY_TABLE).parquet(path)


@plan("encrypt_table", with_readings("""SELECT seq, CAST(price AS VARCHAR) AS price, true AS sealed, true AS known,
   left(sha256(unhex(sha256('master of last year'))), 8) AS master_id FROM readings"""))
def encrypt_table(spark, sf):
    """Encrypt a column under an envelope key, store the table, read it back and open it."""
    path, source = scratch_path(spark, "sealed"), master_keys(OLD_MASTER)
    keys = stored_keys(spark, source, 1)
    df = readings(spark, sf).select("seq", F.col("price").cast("string").alias("price"))
    vault.encrypt(df, "price", keys, source, keys.first().key_id).write.parquet(path)
    stored = spark.read.schema("seq bigint, price string").parquet(path).withColumn("sealed", F.col("price"))
    opened = vault.decrypt(stored, "price", keys, source)
    named = opened.withColumn("key_id", vault.named_key(F.col("sealed"))).join(keys, "key_id", "left")
    return named.select("seq", "price", F.col("sealed").rlike("^enc:v1:[0-9a-f]{8}:[^:]+:[^:]+:[^:]*$").alias("sealed"),
                        F.col("wrapped").isNotNull().alias("known"), "master_id")


@plan("rotate_keys", with_readings("""SELECT seq, CAST(price AS VARCHAR) AS price, left(sha256(unhex(sha256('master of this year'))), 8) AS master_id,
   true AS rewrapped_in_place, seq % 3 = 1 AS untouched FROM readings"""))
def rotate_keys(spark, sf):
    """New master: keys are rewrapped and no row changes. New data key: old and plain values move, its own stay."""
    path, done = scratch_path(spark, "rotate"), scratch_path(spark, "rotated")
    keys = stored_keys(spark, master_keys(OLD_MASTER), 2)
    former, active = sorted(r.key_id for r in keys.collect())
    df = readings(spark, sf).select("seq", F.col("price").cast("string").alias("price"))
    parts = [vault.encrypt(df.filter("seq % 3 = 0"), "price", keys, master_keys(OLD_MASTER), former),
             vault.encrypt(df.filter("seq % 3 = 1"), "price", keys, master_keys(OLD_MASTER), active), df.filter("seq % 3 = 2")]
    parts[0].unionByName(parts[1]).unionByName(parts[2]).write.parquet(path)
    stored = spark.read.schema("seq bigint, price string").parquet(path)

    rewrapped = scratch_path(spark, "keys")
    vault.rewrap(keys, master_keys(NEW_MASTER, OLD_MASTER)).write.parquet(rewrapped)
    keys, source = spark.read.schema(vault.KEY_TABLE).parquet(rewrapped), master_keys(NEW_MASTER)
    still = vault.decrypt(stored, "price", keys, source).withColumnRenamed("price", "still")

    vault.rotate(stored.withColumn("before", F.col("price")), "price", keys, source, active).write.parquet(done)
    moved = spark.read.schema("seq bigint, price string, before string").parquet(done)
    moved = moved.withColumns({"untouched": F.col("price") == F.col("before"), "key_id": vault.named_key(F.col("price"))})
    out = vault.decrypt(moved, "price", keys, source).join(still, "seq").join(keys, "key_id", "left")
    return out.select("seq", "price", "master_id", (F.col("still") == F.col("price")).alias("rewrapped_in_place"), "untouched")


@plan("normalize_price", """SELECT event_id AS seq, upper(event_type) AS asset,
   CAST(CAST(CAST(value AS DECIMAL(20,2)) * 10000000 AS DECIMAL(38,0)) AS VARCHAR) AS price FROM events""")
def normalize_price(spark, sf):
    asset, price = feeds.normalize_price(F.col("event_type"), F.col("value").cast("decimal(20,2)"), F.lit(7))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), asset.alias("asset"), price.cast("string").alias("price"))


_NAMES = "names AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN upper(replace(p_brand, '#', '')) WHEN 1 THEN p_name " \
         "WHEN 2 THEN 'C' || repeat('A', 55) ELSE 'C' || repeat('1', 55) END AS asset FROM part)"


@plan("asset_valid", f"""WITH {_NAMES} SELECT id, regexp_matches(asset, '^[A-Z0-9]{{1,12}}$') OR
   (starts_with(asset, 'C') AND length(asset) = 56) AS valid,
   regexp_matches(asset, '^[A-Z0-9]{{1,12}}$') OR regexp_matches(asset, '^C[A-Z2-7]{{55}}$') AS strict FROM names""")
def asset_valid(spark, sf):
    names = table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "CASE p_partkey % 4 WHEN 0 THEN upper(replace(p_brand, '#', '')) WHEN 1 THEN p_name "
        "WHEN 2 THEN 'C' || repeat('A', 55) ELSE 'C' || repeat('1', 55) END AS asset")
    return names.select("id", validate.asset_valid(F.col("asset")).alias("valid"),
                        validate.asset_valid(F.col("asset"), strict=True).alias("strict"))


@plan("export_request_valid", """SELECT o_orderkey AS id, concat_ws(',',
   CASE WHEN NOT o_orderkey % 5 < 4 THEN 'bad_format' END,
   CASE WHEN o_orderkey % 3 = 0 THEN 'bad_pair' END,
   CASE WHEN o_orderkey % 7 = 0 THEN 'bad_provider' END,
   CASE WHEN o_custkey * 64 NOT BETWEEN 1024 AND 52428800 THEN 'bad_chunk_size' END) AS reasons FROM orders""")
def export_request_valid(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "element_at(array('csv','ndjson','parquet','arrow_ipc','xls'), int(o_orderkey % 5) + 1) AS format",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'btc/usd' ELSE 'BTC-USD' END AS asset_pair",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'ftp' WHEN o_orderkey % 7 = 1 THEN 'gcs' END AS provider",
        "o_custkey * 64 AS chunk_size")
    return export.export_request_reasons(df).select("id", F.array_join("reasons", ",").alias("reasons"))
