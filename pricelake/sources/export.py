"""Exports: CSV, NDJSON, Parquet and Arrow files, manifests, digests, job keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the export request format.
FORMATS = ("csv", "ndjson", "parquet", "arrow_ipc")
PROVIDERS = ("aws_s3", "gcs", "azure_blob")
PAIR_PATTERN = "^[A-Z]{3,4}-[A-Z]{3,4}$"
CHUNK_BYTES = (1024, 52428800)
ROWS_PER_FILE = 100_000
JOB_TTL_MS = 86_400_000
PARQUET_SCHEMA = {"timestamp": "int64", "price": "utf8", "source": "utf8", "assetPair": "utf8"}


def export_rows(history: DataFrame, pair: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(timestamp, price, source, assetPair) rows of one pair in [start, end]."""
    rows = history.filter(F.col("asset") == pair.split("-")[0])
    if start is not None:
        rows = rows.filter(F.col("timestamp") >= start)
    if end is not None:
        rows = rows.filter(F.col("timestamp") <= end)
    return rows.select(
        "timestamp", F.col("price").cast("string").alias("price"), "source", F.lit(pair).alias("assetPair"))


def export_table(rows: DataFrame, path: str, fmt: str, *, compression: str | None = None) -> None:
    """Write an export; files hold at most 100,000 rows each."""
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE)
    if fmt == "arrow_ipc":
        from pricelake.sources.arrow_ipc import ArrowIpcSource

        rows.sparkSession.dataSource.register(ArrowIpcSource)
        rows.write.format("arrow_ipc").option("path", path).mode("overwrite").save()
        return
    if compression:
        writer = writer.option("compression", compression)
    if fmt == "csv":
        writer.option("header", True).option("quoteAll", False).csv(path)
    elif fmt == "ndjson":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}; known: {FORMATS}")


def export_manifest(written: DataFrame) -> DataFrame:
    """Per written file: time range and rows, with the column types."""
    types = F.create_map(*[F.lit(x) for pair in PARQUET_SCHEMA.items() for x in pair])
    return (
        written.groupBy(F.col("_metadata.file_name").alias("partition_key"))
        .agg(
            F.min("timestamp").alias("min_timestamp"),
            F.max("timestamp").alias("max_timestamp"),
            F.count(F.lit(1)).alias("row_count"),
        )
        .withColumn("schema", types)
    )


def export_checksum(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free SHA-256 content digest and row count.

    Row digests are added up in four 60-bit parts, so partial sums merge and
    the result does not depend on files, partitions or row order.
    """
    # Every value with its length, so that no two rows have one line.
    part = lambda c: F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))
    line = F.concat_ws(",", *[F.coalesce(part(F.col(c)), F.lit("-")) for c in columns])
    digest = rows.select(F.sha2(line, 256).alias("h"))
    parts = [
        F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"p{i}") for i in range(4)
    ]
    summed = digest.agg(F.count(F.lit(1)).alias("rows"), *parts)
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"p{i}").cast("string") for i in range(4)])
    return summed.select(F.sha2(text, 256).alias("checksum"), "rows")


def request_key(fmt: Column, pair: Column, start: Column, end: Column) -> Column:
    """SHA-256 of the canonical JSON of a request."""
    body = F.struct(fmt.alias("format"), pair.alias("assetPair"), start.alias("startTime"), end.alias("endTime"))
    return F.sha2(F.to_json(body), 256)


def export_idempotent(requests: DataFrame, ledger: DataFrame, *, now_ms: Column) -> DataFrame:
    """Job per request: the live job of the same key, else one new job per key.

    `requests` has key, seq and job_id (used when new); `ledger` key, job_id,
    created_ms. A key is live for 24 hours.
    """
    live = ledger.filter(now_ms <= F.col("created_ms") + JOB_TTL_MS)
    live = live.groupBy("key").agg(F.max_by("job_id", "created_ms").alias("live_job"))
    first = requests.groupBy("key").agg(F.min_by("job_id", "seq").alias("new_job"), F.min("seq").alias("first_seq"))
    jobs = first.join(live, "key", "left").select(
        "key", F.coalesce("live_job", "new_job").alias("assigned_job"),
        F.when(F.col("live_job").isNull(), F.col("first_seq")).alias("started_by"))
    return requests.join(jobs, "key").withColumn("is_new", F.coalesce(F.col("seq") == F.col("started_by"), F.lit(False)))


def export_request_reasons(requests: DataFrame) -> DataFrame:
    """Add `reasons`: every rule a request breaks (empty for a valid one)."""
    rules = {
        "bad_format": F.col("format").isin(*FORMATS),
        "bad_pair": F.col("asset_pair").rlike(PAIR_PATTERN),
        "bad_provider": F.col("provider").isNull() | F.col("provider").isin(*PROVIDERS),
        "bad_chunk_size": F.coalesce(F.col("chunk_size"), F.lit(1048576)).between(*CHUNK_BYTES),
    }
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return requests.withColumn("reasons", F.filter(broken, lambda r: r.isNotNull()))


def read_export(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    from pricelake.schemas import EXPORT_ROWS

    if fmt == "csv":
        return spark.read.schema(EXPORT_ROWS).option("header", True).csv(path)
    if fmt == "ndjson":
        return spark.read.schema(EXPORT_ROWS).json(path)
    if fmt == "parquet":
        return spark.read.schema(EXPORT_ROWS).parquet(path)
    from pricelake.sources.arrow_ipc import ArrowIpcSource

    spark.dataSource.register(ArrowIpcSource)
    return spark.read.format("arrow_ipc").schema(EXPORT_ROWS).option("path", path).load()
