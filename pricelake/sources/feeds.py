"""Raw feed payloads of four shapes -> normalised readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricelake.functions import decimals as D
from pricelake.schemas import FEED_DECIMALS, FEED_PAYLOADS

# Feed symbols per asset; other assets use the feed's default form.
BAND_SYMBOLS = {"XLM": "XLM", "USDC": "USDC-USD", "BTC": "BTC-USD", "ETH": "ETH-USD", "USDT": "USDT-USD"}
PLAIN_SYMBOLS = {"XLM": "XLM", "USDC": "USDC", "BTC": "BTC", "ETH": "ETH", "USDT": "USDT"}


def _entry(price: Column, decimals: Column | None = None, timestamp: Column | None = None, scale: int = 8) -> Column:
    """What one feed says: price text, decimals and time, with the feed's defaults."""
    none = F.lit(None).cast("string")
    return F.struct(
        price.alias("raw"),
        _or_default(decimals if decimals is not None else none, F.lit(scale).cast("bigint")).cast("int").alias("decimals"),
        _or_default(timestamp if timestamp is not None else none, F.col("ingest_ts")).alias("timestamp"),
    )


def feeds() -> dict[str, Column]:
    """Entry struct per feed, over the columns `payload`, `asset` and `ingest_ts`.

    A further feed is one more item: where its price, decimals and time are.
    """
    payload = F.col("payload")
    item = "STRUCT<value: STRING, decimals: STRING>"
    quote = "STRUCT<price: STRING, decimals: STRING, timestamp: STRING>"
    by_symbol = F.try_element_at(F.from_json(payload, f"MAP<STRING, {item}>"), F.upper("asset"))
    pair = F.concat(F.lit("Crypto."), F.col("asset"), F.lit("/USD"))
    by_pair = F.try_element_at(F.from_json(payload, f"STRUCT<prices: MAP<STRING, {quote}>>")["prices"], pair)
    data = F.from_json(payload, "STRUCT<data: STRUCT<price: STRING, decimals: STRING, updated_at: STRING>>")["data"]
    return {
        "chainlink": _entry(F.get_json_object(payload, "$.USD.PRICE")),
        "redstone": D.bind(by_symbol, lambda e: _entry(e["value"], e["decimals"])),
        "band": D.bind(data, lambda e: _entry(e["price"], e["decimals"], e["updated_at"], FEED_DECIMALS["band"])),
        "reflector": D.bind(by_pair, lambda e: _entry(e["price"], e["decimals"], e["timestamp"])),
    }


def _or_default(text: Column, default: Column) -> Column:
    """Missing, unreadable and 0 all fall back to the default."""
    number = text.try_cast("double").try_cast("bigint")
    return F.coalesce(F.nullif(number, F.lit(0).cast("bigint")), default)


def normalize_price(asset: Column, raw: Column, decimals: Column) -> tuple[Column, Column]:
    """(upper-case asset, raw * 10^decimals rounded half away from zero)."""
    return F.upper(asset), D.shift_point(raw, decimals)


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Payload rows -> readings plus `reason` (null for a good reading).

    Other columns, such as an arrival number, are kept. Payloads without a price
    give no row; prices beyond 38 digits get the reason `price_overflow`.
    """
    entry = None
    for name, found in feeds().items():
        here = F.col("source") == name
        entry = F.when(here, found) if entry is None else entry.when(here, found)

    def has_price(e: Column) -> Column:
        zero = F.coalesce(e["raw"].try_cast("double") == 0, F.lit(False))
        return e["raw"].isNotNull() & (e["raw"] != "") & ~zero

    # Exploding the filtered one-element array parses every payload once; a plain
    # filter would be pushed below the projection and parse it again.
    out = payloads.withColumn("__e", F.explode(F.filter(F.array(entry), has_price)))
    out = out.select(*[c for c in payloads.columns], "__e.*")
    asset, price = normalize_price(F.col("asset"), F.col("raw"), F.col("decimals"))
    out = out.withColumns({"asset": asset, "price": price})
    number = F.col("raw").try_cast("double").isNotNull()
    return out.withColumn(
        "reason", F.when(F.col("price").isNull(), F.when(number, "price_overflow").otherwise("not_a_number"))
    ).drop("payload")


def scan_feed_payloads(payloads: DataFrame) -> DataFrame:
    good = parse_payloads(payloads).filter("reason IS NULL")
    return good.drop("reason", "raw", "ingest_ts")


def quarantine(payloads: DataFrame) -> DataFrame:
    return parse_payloads(payloads).filter("reason IS NOT NULL")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landing files: one JSON object per line with the payload as text."""
    return spark.read.schema(FEED_PAYLOADS).json(path)


def symbol_of(asset: Column, source: Column) -> Column:
    """The symbol under which a feed lists an asset; null for an unknown feed."""
    upper = F.upper(asset)
    default = {
        "chainlink": asset,
        "band": F.concat(asset, F.lit("-USD")),
        "redstone": upper,
        "reflector": F.concat(F.lit("Crypto."), asset, F.lit("/USD")),
    }
    out = F.lit(None).cast("string")
    for name, symbol in default.items():
        for code, known in {"chainlink": PLAIN_SYMBOLS, "band": BAND_SYMBOLS}.get(name, {}).items():
            symbol = F.when(upper == code, known).otherwise(symbol)
        out = F.when(source == name, symbol).otherwise(out)
    return out


def symbol_map(pairs: DataFrame) -> DataFrame:
    """Add `symbol` to (asset, source) pairs, in one pass for all feeds."""
    return pairs.withColumn("symbol", symbol_of(F.col("asset"), F.col("source")))


def render_payloads(readings: DataFrame) -> DataFrame:
    """Readings as the payload texts the four feeds would have sent."""
    value = (F.col("price") / D.pow10(F.col("decimals"))).cast("decimal(38,8)").cast("string")
    stamp, asset = F.col("timestamp"), F.col("asset")
    shapes = {
        "chainlink": F.concat(F.lit('{"USD":{"PRICE":'), value, F.lit("}}")),
        "redstone": F.to_json(F.create_map(asset, F.struct(value.alias("value"), F.col("decimals")))),
        "band": F.to_json(F.struct(F.struct(
            value.alias("price"), F.col("decimals"), stamp.alias("updated_at")).alias("data"))),
        "reflector": F.to_json(F.struct(F.create_map(
            F.concat(F.lit("Crypto."), asset, F.lit("/USD")),
            F.struct(value.alias("price"), F.col("decimals"), stamp.alias("timestamp"))).alias("prices"))),
    }
    payload = None
    for name, text in shapes.items():
        payload = F.when(F.col("source") == name, text) if payload is None else payload.when(
            F.col("source") == name, text)
    extra = [c for c in readings.columns if c not in ("price", "decimals", "timestamp", "asset", "source")]
    return readings.select(*extra, "source", "asset", payload.alias("payload"), stamp.alias("ingest_ts"))
