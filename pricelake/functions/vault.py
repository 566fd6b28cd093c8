"""Column encryption at rest: `enc:v1:<keyId>:<iv>:<tag>:<ct>` (AES-256-GCM) under envelope keys.

Values are sealed with data keys. A data key is stored only in a key table, wrapped by a master
key; which master, the table says. Master keys come from a function that runs on an executor
(it reads a mounted secret, an environment variable, a secret service) and move as data of the job:
no key is in a plan, in `explain()` or in an event log. Changing the master key rewraps the key
table and touches no row of the data.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the payload format.
PREFIX = "enc"
VERSION = "v1"

KEY_BYTES = 32
KEY_TABLE = "key_id string, master_id string, wrapped string"

#: Returns master keys; called on an executor.
MasterKeys = Callable[[], Iterable[bytes]]


def key_id(key: Column) -> Column:
    """The public name of a key."""
    return F.substring(F.sha2(key, 256), 1, 8)


def is_encrypted(value: Column) -> Column:
    return F.coalesce(value.startswith(f"{PREFIX}:{VERSION}:"), F.lit(False))


def named_key(value: Column) -> Column:
    """Id of the key that a payload is sealed with; null for plain text."""
    return F.when(is_encrypted(value), F.get(F.split(value, ":"), F.lit(2)))


def seal(value: Column, key: Column) -> Column:
    """Encrypt a text column under the key of the row; null stays null.

    The cipher text is bound to a lambda variable so that its three parts come
    from one evaluation (every evaluation draws a new IV).
    """
    sealed = F.aes_encrypt(value, key, F.lit("GCM"))

    def pack(blob: Column) -> Column:
        iv, body = F.substring(blob, F.lit(1), F.lit(12)), F.length(blob) - 28
        cipher = F.substring(blob, F.lit(13), body)
        tag = F.substring(blob, F.lit(13) + body, F.lit(16))
        text = [F.base64(part) for part in (iv, tag, cipher)]
        return F.concat_ws(":", F.lit(PREFIX), F.lit(VERSION), key_id(key), *text)

    return F.when(value.isNotNull(), F.element_at(F.transform(F.array(sealed), pack), 1))


def open_sealed(value: Column, key: Column) -> Column:
    """Decrypt under the key of the row, which must be the payload's; plain text passes through."""
    part = F.split(value, ":")
    blob = F.concat(F.unbase64(F.get(part, 3)), F.unbase64(F.get(part, 5)), F.unbase64(F.get(part, 4)))
    missing = F.raise_error(F.concat(F.lit("no key for key id "), F.coalesce(F.get(part, 2), F.lit("(none)")))).cast("string")
    text = F.when(key.isNull(), missing).otherwise(F.aes_decrypt(blob, key, F.lit("GCM")).cast("string"))
    return F.when(is_encrypted(value), text).otherwise(value)


def _masters(spark: SparkSession, source: MasterKeys) -> DataFrame:
    """(master_id, master), fetched by one task."""

    def fetch(frames):
        for _ in frames:
            yield pd.DataFrame({"master": [bytes(k) for k in source()]})

    keys = spark.range(0, 1, 1, 1).mapInPandas(fetch, "master binary")
    return keys.select(key_id(F.col("master")).alias("master_id"), "master")


def create_keys(spark: SparkSession, source: MasterKeys, count: int = 1) -> DataFrame:
    """New data keys (key_id, master_id, wrapped) under the first master key. Store the result: reading it twice
    makes other keys."""

    def draw(frames):
        for _ in frames:
            master = next(iter(source()))
            yield pd.DataFrame([(os.urandom(KEY_BYTES), bytes(master)) for _ in range(count)], columns=["key", "master"])

    drawn = spark.range(0, 1, 1, 1).mapInPandas(draw, "key binary, master binary")
    return drawn.select(
        key_id(F.col("key")).alias("key_id"), key_id(F.col("master")).alias("master_id"),
        F.base64(F.aes_encrypt("key", "master", F.lit("GCM"))).alias("wrapped"))


def open_keys(keys: DataFrame, source: MasterKeys) -> DataFrame:
    """(key_id, key) of all data keys whose master key the source has. To be joined, never stored."""
    masters = _masters(keys.sparkSession, source)
    plain = F.aes_decrypt(F.unbase64("wrapped"), F.col("master"), F.lit("GCM"))
    return keys.join(masters, "master_id").select("key_id", plain.alias("key"))


def encrypt(df: DataFrame, column: str, keys: DataFrame, source: MasterKeys, active: str) -> DataFrame:
    """`df` with `column` sealed under the data key `active`; an unknown key is an error."""
    opened = open_keys(keys.filter(F.col("key_id") == active), source).select(F.col("key").alias("__key"), F.lit(0).alias("__one"))
    missing = F.raise_error(F.lit(f"no key for key id {active}")).cast("string")
    sealed = F.when(F.col("__key").isNull(), missing).otherwise(seal(F.col(f"`{column}`"), F.col("__key")))
    joined = df.withColumn("__one", F.lit(0)).join(opened, "__one", "left")
    return joined.withColumn(column, sealed).select(*[f"`{c}`" for c in df.columns])


def decrypt(df: DataFrame, column: str, keys: DataFrame, source: MasterKeys) -> DataFrame:
    """`df` with `column` opened, each payload with the key that it names; plain text passes through."""
    opened = open_keys(keys, source).select(F.col("key_id").alias("__named"), F.col("key").alias("__key"))
    joined = df.withColumn("__named", named_key(F.col(f"`{column}`"))).join(opened, "__named", "left")
    return joined.withColumn(column, open_sealed(F.col(f"`{column}`"), F.col("__key"))).select(*[f"`{c}`" for c in df.columns])


def rewrap(keys: DataFrame, source: MasterKeys) -> DataFrame:
    """The key table under the first master key of the source, which must have the former ones as well.

    Data keys and their ids stay, so no sealed value changes.
    """

    def first(frames):
        for _ in frames:
            yield pd.DataFrame({"target": [bytes(next(iter(source())))]})

    target = keys.sparkSession.range(0, 1, 1, 1).mapInPandas(first, "target binary").withColumn("__one", F.lit(0))
    opened = keys.join(_masters(keys.sparkSession, source), "master_id", "left").withColumn("__one", F.lit(0)).join(target, "__one")
    known = F.col("master").isNotNull()
    plain = F.aes_decrypt(F.unbase64("wrapped"), F.col("master"), F.lit("GCM"))
    missing = F.raise_error(F.concat(F.lit("no master key "), F.col("master_id"))).cast("string")
    done = key_id(F.col("target")) == F.col("master_id")
    wrapped = F.when(~known, missing).when(done, F.col("wrapped")).otherwise(
        F.base64(F.aes_encrypt(plain, F.col("target"), F.lit("GCM"))))
    return opened.select("key_id", key_id(F.col("target")).alias("master_id"), wrapped.alias("wrapped"))


def rotate(df: DataFrame, column: str, keys: DataFrame, source: MasterKeys, active: str) -> DataFrame:
    """Seal again, under the data key `active`, what is not: payloads of other data keys and plain text."""
    value = F.col(f"`{column}`")
    mine = F.coalesce(named_key(value) == active, F.lit(False))
    names = df.columns
    kept = df.withColumns({"__before": F.when(mine, value), column: F.when(~mine, value)})
    moved = encrypt(decrypt(kept, column, keys, source), column, keys, source, active)
    return moved.withColumn(column, F.coalesce("__before", F.col(f"`{column}`"))).select(*[f"`{c}`" for c in names])
