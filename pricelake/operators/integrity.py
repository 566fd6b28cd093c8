"""Merkle commitments over reading batches, and the audit log's HMAC chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricelake.functions import decimals as D
from pricelake.operators.chunks import CHUNK_ROWS, drop_halo, with_halo
from pricelake.session import materialize
from pricelake.sources import files

#: Tree levels folded per shuffle; a block has 2^LEVELS leaves.
LEVELS = 10
BLOCK = 1 << LEVELS


def sha(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def _be(value: Column, width: int) -> Column:
    """Unsigned big-endian hex text of `width` bytes."""
    return F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")


def int128(value: Column) -> Column:
    """Signed 16-byte big-endian bytes of a DECIMAL(38,0)."""
    negative = value < 0
    base = F.lit(2**32).cast("decimal(10,0)")
    rest = F.when(negative, F.lit(-1).cast(D.WIDE) - value).otherwise(value).cast(D.WIDE)
    words = []
    for _ in range(4):
        word = F.try_mod(rest, base)
        words.append(F.when(negative, F.lit(2**32 - 1) - word.cast("bigint")).otherwise(word.cast("bigint")))
        rest = D.whole_div(rest, base)
    return F.unhex(F.concat(*[_be(w, 4) for w in reversed(words)]))


def merkle_leaf(entries: DataFrame) -> DataFrame:
    """Add `leaf`: SHA-256(asset, 00, price 16 bytes, decimals 4, timestamp 8, source)."""
    encoded = F.concat(
        F.encode("asset", "UTF-8"), F.unhex(F.lit("00")), int128(F.col("price")),
        F.unhex(_be(F.col("decimals"), 4)), F.unhex(_be(F.col("timestamp"), 8)), F.encode("source", "UTF-8"))
    return entries.withColumn("leaf", sha(encoded))


def _parents(nodes: Column) -> Column:
    """The next tree level: pairs by position, an odd last node pairs with itself."""
    n = F.size(nodes)
    pairs = F.sequence(F.lit(1), n, F.lit(2))
    return F.transform(pairs, lambda i: sha(F.concat(
        F.element_at(nodes, i), F.element_at(nodes, F.least(i + 1, n)))))


def _climb(nodes: Column, levels: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), levels), nodes, lambda acc, _: _parents(acc))


def _height(n: Column) -> Column:
    """Levels above n nodes: ceil(log2 n), exact for counts up to 2^40."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(40)), F.lit(0), lambda acc, i: acc + F.when(F.pow(F.lit(2.0), i - 1) < n, 1).otherwise(0))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Group nodes (nonce, idx, hash) into blocks of at most 1024, in order."""
    block = F.floor(F.col("idx") / BLOCK).alias("block")
    grouped = nodes.groupBy("nonce", block).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda s: s["hash"]).alias("nodes"))
    sizes = grouped.groupBy("nonce").agg(F.count(F.lit(1)).alias("blocks"))
    grouped = grouped.join(sizes, "nonce")
    # A batch of one block stops at its root; otherwise every block rises LEVELS.
    levels = F.when(F.col("blocks") > 1, F.lit(LEVELS)).otherwise(_height(F.size("nodes")))
    return grouped.withColumn("levels", levels.cast("int"))


def _rise(blocks: DataFrame) -> DataFrame:
    top = F.when(F.col("levels") > 0, _climb(F.col("nodes"), F.greatest(F.col("levels"), F.lit(1)))).otherwise(F.col("nodes"))
    return blocks.select("nonce", F.col("block").alias("idx"), F.element_at(top, 1).alias("hash"))


def _largest(leaves: DataFrame) -> int:
    return (leaves.agg(F.max("idx")).first()[0] or 0) + 1


def merkle_root(leaves: DataFrame) -> DataFrame:
    """Root per batch from (nonce, leaf_index, leaf); ten levels per shuffle."""
    nodes = leaves.select("nonce", F.col("leaf_index").alias("idx"), F.col("leaf").alias("hash"))
    n = _largest(nodes)
    while True:
        nodes = _rise(_blocks(nodes))
        n = -(-n // BLOCK)
        if n <= 1:
            break
        nodes = materialize(nodes, "merkle")
    return nodes.select("nonce", F.col("hash").alias("root"))


def _paths(blocks: DataFrame) -> DataFrame:
    """Sibling path of every node inside its block."""
    start = F.array(F.col("nodes"))
    steps = F.sequence(F.lit(1), F.greatest(F.col("levels"), F.lit(1)))
    ladder = F.when(
        F.col("levels") > 0,
        F.aggregate(steps, start, lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1))))),
    ).otherwise(start)
    with_levels = blocks.withColumn("__ladder", ladder)
    each = with_levels.select("nonce", "block", "levels", "__ladder", F.posexplode("nodes").alias("__i", "__node"))

    def sibling(level: Column) -> Column:
        row = F.element_at(F.col("__ladder"), level)
        spot = F.floor(F.col("__i") / F.pow(F.lit(2.0), level - 1)).cast("int")
        beside = F.when(spot % 2 == 0, spot + 1).otherwise(spot - 1)
        return F.element_at(row, F.when(beside < F.size(row), beside).otherwise(spot) + 1)

    path = F.when(
        F.col("levels") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("levels"), F.lit(1))), sibling)
    ).otherwise(F.array().cast("array<binary>"))
    return each.select(
        "nonce", (F.col("block") * BLOCK + F.col("__i")).alias("idx"), "block", path.alias("siblings"))


def merkle_proof(leaves: DataFrame) -> DataFrame:
    """Sibling path of every leaf: inside its block, then along the block roots."""
    nodes = leaves.select("nonce", F.col("leaf_index").alias("idx"), F.col("leaf").alias("hash"))
    n = _largest(nodes)
    levels = []
    while True:
        blocks = _blocks(nodes)
        levels.append(_paths(blocks))
        n = -(-n // BLOCK)
        if n <= 1:
            break
        nodes = materialize(_rise(blocks), "merkle")
    proof = levels[-1].select("nonce", "idx", "siblings")
    for lower in reversed(levels[:-1]):
        upper = proof.select("nonce", F.col("idx").alias("block"), F.col("siblings").alias("__up"))
        proof = lower.join(upper, ["nonce", "block"]).select(
            "nonce", "idx", F.concat("siblings", "__up").alias("siblings"))
    return proof.select("nonce", F.col("idx").alias("leaf_index"), "siblings")


# -- stored trees ---------------------------------------------------------------

NODES = "nonce bigint, level int, idx bigint, hash binary, top boolean"


def merkle_levels(leaves: DataFrame) -> DataFrame:
    """All nodes (nonce, level, idx, hash, top) of the batches' trees; the leaves are read once.

    A block of 1,024 gives its ten levels at once; the block roots are the nodes of the next round.
    """
    nodes = leaves.select("nonce", F.col("leaf_index").alias("idx"), F.col("leaf").alias("hash"))
    out, base = None, 0
    while True:
        blocks = _blocks(nodes)
        steps = F.sequence(F.lit(1), F.greatest(F.col("levels"), F.lit(1)))
        start = F.array(F.col("nodes"))
        ladder = F.when(F.col("levels") > 0, F.aggregate(
            steps, start, lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1)))))).otherwise(start)
        rows = blocks.select("nonce", "block", "levels", "blocks", F.posexplode(ladder).alias("up", "row"))
        width = F.floor(F.col("block") * BLOCK / F.pow(F.lit(2.0), F.col("up"))).cast("bigint")
        rows = rows.select("nonce", "up", "levels", "blocks", width.alias("first"), F.posexplode("row").alias("at", "hash"))
        last = (F.col("up") == F.col("levels")) & (F.col("blocks") == 1)
        rows = materialize(rows.select(
            "nonce", (F.col("up") + base).alias("level"), (F.col("first") + F.col("at")).alias("idx"), "hash", last.alias("top"),
            (F.col("up") == LEVELS).alias("rises")), "merkle-levels")
        # A block root is a leaf of the next round, which writes the levels above it.
        part = rows.drop("rises")
        out = part if out is None else out.unionByName(part.filter(F.col("level") > base))
        # Batches of one block are done; the roots of the others rise.
        nodes = rows.filter(F.col("rises") & ~F.col("top")).select("nonce", "idx", "hash")
        if nodes.isEmpty():
            return out
        base += LEVELS


def merkle_append(spark: SparkSession, leaves: DataFrame, store: str) -> None:
    """Add the trees of new batches to the node table `store`; batches that it has stay untouched.

    Run again after a failure, it adds what is missing: a batch counts as stored once its top is, and a
    folder of nodes appears with its last file (Parquet commits an append as a whole).
    """
    known = merkle_roots(spark, store)
    new = leaves if known is None else leaves.join(known.select("nonce"), "nonce", "left_anti")
    merkle_levels(new).repartitionByRange("nonce", "level", "idx").sortWithinPartitions("nonce", "level", "idx").write.mode(
        "append").parquet(store)


def _stored_nodes(spark: SparkSession, store: str) -> DataFrame | None:
    return spark.read.schema(NODES).parquet(store) if files.exists(spark, store) else None


def merkle_roots(spark: SparkSession, store: str) -> DataFrame | None:
    """(nonce, root, height) of the stored batches; None without a store."""
    nodes = _stored_nodes(spark, store)
    return None if nodes is None else nodes.filter("top").select(
        "nonce", F.col("hash").alias("root"), F.col("level").alias("height"))


def merkle_stored_proof(spark: SparkSession, store: str, nonce: int, leaf_index: int) -> list[bytes]:
    """Sibling path of one leaf: at most two stored nodes a level are read, by pushed-down filters."""
    nodes = _stored_nodes(spark, store).filter(F.col("nonce") == nonce)
    height = nodes.filter("top").first()["level"]
    near = F.lit(False)
    for level in range(height):
        spot = leaf_index >> level
        near = near | ((F.col("level") == level) & F.col("idx").isin(spot, spot ^ 1))
    found = {(r.level, r.idx): bytes(r.hash) for r in nodes.filter(near).collect()}
    spots = [(level, leaf_index >> level) for level in range(height)]
    # An odd last node is its own sibling.
    return [found.get((level, spot ^ 1), found.get((level, spot))) for level, spot in spots]


def merkle_stored_proofs(spark: SparkSession, store: str, wanted: DataFrame) -> DataFrame:
    """`wanted` (nonce, leaf_index) with `siblings` and `root`: a join of one row a level with the node table."""
    nodes = _stored_nodes(spark, store).select("nonce", "level", "idx", "hash")
    roots = merkle_roots(spark, store)
    leaf = wanted.select("nonce", "leaf_index").distinct().join(roots, "nonce")
    levels = F.sequence(F.lit(0), F.col("height") - 1)
    asked = leaf.filter(F.col("height") > 0).select("nonce", "leaf_index", F.explode(levels).alias("level"))
    spot = F.floor(F.col("leaf_index") / F.pow(F.lit(2.0), F.col("level"))).cast("bigint")
    asked = asked.withColumn("spot", spot).withColumn(
        "idx", F.explode(F.array(F.col("spot"), F.col("spot").bitwiseXOR(F.lit(1).cast("bigint")))))
    found = asked.join(nodes, ["nonce", "level", "idx"])
    steps = found.groupBy("nonce", "leaf_index", "level").agg(F.max_by("hash", F.col("idx") != F.col("spot")).alias("hash"))
    paths = steps.groupBy("nonce", "leaf_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", "hash"))), lambda s: s["hash"]).alias("siblings"))
    out = leaf.join(paths, ["nonce", "leaf_index"], "left")
    return out.select("nonce", "leaf_index", F.coalesce("siblings", F.array().cast("array<binary>")).alias("siblings"), "root")


def merkle_verify(proofs: DataFrame) -> DataFrame:
    """Add `valid`: whether (leaf, leaf_index, siblings) leads to `root`."""
    start = F.struct(F.col("leaf").alias("h"), F.col("leaf_index").cast("bigint").alias("i"))

    def step(acc: Column, s: Column) -> Column:
        pair = F.when(acc["i"] % 2 == 0, F.concat(acc["h"], s)).otherwise(F.concat(s, acc["h"]))
        return F.struct(sha(pair).alias("h"), F.floor(acc["i"] / 2).cast("bigint").alias("i"))

    return proofs.withColumn("valid", F.aggregate("siblings", start, step)["h"] == F.col("root"))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 as hex text, from two SHA-256 over padded keys."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def audit_chain_verify(log: DataFrame, key: bytes, size: int = CHUNK_ROWS) -> DataFrame:
    """Add `intact`: the stored HMAC equals HMAC(json followed by the previous HMAC).

    Each row needs only its predecessor, so the chain is checked in chunks.
    """
    framed, order = with_halo(log, [], "seq", 1, size)
    previous = F.coalesce(F.lag("hmac").over(order), F.lit(""))
    framed = framed.withColumn("__prev", previous)
    out = drop_halo(framed)
    return out.withColumn("intact", hmac_sha256(F.concat("json", "__prev"), key) == F.col("hmac")).drop("__prev")
