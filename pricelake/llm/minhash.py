"""Near-duplicate groups by tensored MinHash banding, confirmed on full shingle sets.

Texts are compared by their sets of distinct five-word shingles; two are linked if
their Jaccard similarity is `threshold` or more, and groups are connected components.

1. One pass hashes shingles and takes `COLLECTIONS` x `ROWS` minhashes. Each collection
   combines its `ROWS` minhashes to one value; a table key combines the values of two
   collections. 16 collections of 2 give 120 tables of 4 minhashes from 32 hash
   functions instead of 480. A pair at 0.75 agrees on a collection with probability
   0.5625, so it misses every table (fewer than two collections) once in 26,000.
2. Equal sets are one node (grouped by a 128-bit digest of the set), so thousands of
   copies cost what one text costs.
3. Only collection values that occur twice are paired into keys: most texts drop out
   before any table key is made.
4. Each bucket links its members to the one that meets most others in all tables; those
   pairs are confirmed first and joined into components. Then the nodes that share a bucket with another component
   are compared across components, so the star shape loses no link. A prefix filter,
   which loses none either, keeps this from being all pairs of a bucket.

Links, labels and sets stay in tables; labels are contracted by alternating large and
small stars. All groupings combine on the map side; joins may be split by AQE.

Defined results: null texts, empty texts and texts without words have the empty set
and are linked with nothing; fewer than five words are one shingle; a group's id is
its smallest document id, null ids come last; rows with equal ids are separate
documents; extra columns pass through `group_near`, those named as a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pricelake.llm import text as tx
from pricelake.session import materialize

WIDTH = 5
COLLECTIONS = 16
ROWS = 2
SIGNS = "doc long, mark string, n long, f1 long, f2 long, values array<long>"

_SEEDS = tx.mix(np.arange(1, 2 * COLLECTIONS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingles(block: tx.Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a block, and bounds: row i has hashes bounds[i]:bounds[i + 1]."""
    data = tx.LOWER[block.data]
    starts, stops, bounds = tx.words(data, block.ends)
    word = tx.span_hash(tx.prefix_sums(tx.BYTE_CODES[data]), starts, stops)
    count = np.diff(bounds)
    sums = tx.prefix_sums(word)
    full = np.maximum(count - width + 1, np.minimum(count, 1))
    out = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=out[1:])
    first = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], full)
    last = np.minimum(first + width, np.repeat(bounds[1:], full))
    return tx.span_hash(sums, first, last), out


def _sign(batches):
    for block in tx.blocks(batches, "text", tx.SMALL_BLOCK_BYTES):
        hashes, bounds = shingles(block)
        rows = len(bounds) - 1
        size = np.zeros(rows, np.int64)
        digest = np.zeros((2, rows), np.uint64)
        other = tx.mix(hashes + np.uint64(1))
        for i in range(rows):
            a, b = bounds[i], bounds[i + 1]
            if a < b:
                _, at = np.unique(hashes[a:b], return_index=True)
                size[i] = len(at)
                digest[0, i] = hashes[a:b][at].sum()
                digest[1, i] = other[a:b][at].sum()
        some = np.flatnonzero(size)
        values = np.zeros((rows, COLLECTIONS), np.uint64)
        if len(some):
            for c in range(COLLECTIONS):
                mixed = np.full(len(some), _SEEDS[c], np.uint64)
                for r in range(ROWS):
                    k = 2 * (c * ROWS + r)
                    mixed = tx.mix(mixed + np.minimum.reduceat(hashes * _SEEDS[k] + _SEEDS[k + 1], bounds[some]))
                values[some, c] = mixed
        lists = np.where(size > 0, COLLECTIONS, 0)
        offsets = np.concatenate(([0], np.cumsum(lists))).astype(np.int32)
        span = lambda i: block.batch.column(i).slice(block.first, rows)
        yield pa.RecordBatch.from_arrays(
            [span(0), span(1), pa.array(size), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[some].ravel().view(np.int64)))],
            ["doc", "mark", "n", "f1", "f2", "values"])


def _sets(batches):
    for block in tx.blocks(batches, "text", tx.SMALL_BLOCK_BYTES):
        hashes, bounds = shingles(block)
        rows = [np.unique(hashes[bounds[i]:bounds[i + 1]]) for i in range(len(bounds) - 1)]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [block.batch.column(0).slice(block.first, len(rows)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], ["node", "items"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in `links` (a, b): the smallest node it is connected with."""
    edges = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    state = None
    while True:
        # Large star: the larger neighbours of a node move to its smallest neighbour (or itself).
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        moved = large.join(low, F.col("a") == F.col("u"))
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        edges = materialize(small.filter("a > b").distinct(), "edges")
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    whole = F.size("items_a") + F.size("items_b") - common
    return materialize(both.filter(common * 100 >= whole * percent).select("a", "b"), name)


def _across(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of `nodes` (node, n, root) with different roots that may be similar enough; none that is, is left out.

    With shingles ordered from rare to common, two sets that are similar enough share one
    of the first n - ceil(n * percent / 100) + 1 of each, and that one must leave enough
    behind it in both. In a family of edited copies the rare shingles are the edits, which
    hardly two copies share, and few follow in both. Of the pairs at one shingle at least one
    node is outside the component that is most frequent there, so only such nodes are
    paired with the others.
    """
    items = sets.join(nodes, "node").select("node", "n", "root", F.explode("items").alias("h"))
    common = items.groupBy("h").agg(
        F.count("*").alias("f"), (F.min("root") < F.max("root")).alias("mixed")).filter("f > 1")
    own = W.partitionBy("node")
    head = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    alone = F.col("n") - F.count("*").over(own)  # shingles of no other node come first
    heads = items.join(common, "h").withColumn("alone", alone).withColumn(
        "at", F.col("alone") + F.row_number().over(own.orderBy("f", "h"))).filter((F.col("at") <= head) & F.col("mixed"))
    heads = materialize(heads.select("h", "node", "n", "root", "at"), "heads")
    most = heads.groupBy("h", "root").agg(F.count("*").alias("times")).groupBy("h").agg(
        F.max_by("root", "times").alias("main"), F.count("*").alias("kinds")).filter("kinds > 1").select("h", "main")
    heads = heads.join(materialize(most, "main-roots"), "h")
    side = lambda df, k: df.select(
        "h", F.col("node").alias(f"node{k}"), F.col("n").alias(f"n{k}"), F.col("root").alias(f"root{k}"), F.col("at").alias(f"at{k}"))
    # At their first common shingle, two sets can share no more than it and what follows.
    most = 1 + F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    fit = (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent) & (
        most * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent)
    return side(heads.filter("root != main"), 1).join(side(heads, 2), "h").filter(
        (F.col("root1") != F.col("root2")) & fit
    ).select(F.greatest("node1", "node2").alias("a"), F.least("node1", "node2").alias("b")).distinct()


def near_groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """For `docs` (doc, mark, text): (doc, mark, n, root) - root is null for the empty set, else its group's smallest doc."""
    signs = materialize(
        docs.select("doc", "mark", "text").mapInArrow(_sign, SIGNS)
        .withColumn("row", F.monotonically_increasing_id()), "signs")
    filled = signs.filter("n > 0")
    classes = filled.groupBy("f1", "f2").agg(
        F.min("row").alias("node"), F.min("doc").alias("least"), F.first("n").alias("n"))
    classes = materialize(classes, "classes")
    nodes = filled.join(classes.select(F.col("node").alias("row")), "row").select(
        F.col("row").alias("node"), "doc", "mark", "n", "values")

    # Table keys, only from collection values that occur twice.
    values = nodes.select("node", F.posexplode("values").alias("c", "v"))
    twice = materialize(
        values.groupBy("c", "v").agg(F.count("*").alias("times")).filter("times > 1").select("c", "v"), "shared-values")
    kept = values.join(twice, ["c", "v"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs"))
    pair = lambda x, i: F.transform(
        F.slice(F.col("vs"), i + 2, F.size("vs")), lambda y: F.xxhash64(x["c"], x["v"], y["c"], y["v"]))
    keys = kept.filter(F.size("vs") > 1).select("node", F.explode(F.flatten(F.transform("vs", pair))).alias("key"))
    keys = materialize(keys, "table-keys")
    counts = materialize(keys.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1"), "bucket-sizes")
    shared = keys.join(counts, "key")
    # A node that meets many others is the least edited of its family: the best center.
    weights = shared.groupBy("node").agg(F.sum(F.col("times") - 1).alias("weight"))
    shared = materialize(shared.select("key", "node").join(materialize(weights, "weights"), "node"), "shared-keys")
    buckets = shared.groupBy("key").agg(F.max_by("node", "weight").alias("center"))
    members = materialize(
        shared.select("key", "node").join(materialize(buckets, "centers"), "key")
        .join(nodes.select("node", "n"), "node"), "buckets")

    sized = nodes.select(F.col("node").alias("center"), F.col("n").alias("m"))
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    stars = members.filter("node != center").groupBy("center", "node").agg(F.first("n").alias("n"))
    stars = materialize(
        stars.join(sized, "center").filter(fits(F.col("n"), F.col("m")))
        .select(F.greatest("node", "center").alias("a"), F.least("node", "center").alias("b")).distinct(), "stars")

    # Full sets of the nodes that share a bucket, from one text each.
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "doc", "mark")
    sets = docs.join(wanted, ["doc", "mark"]).select("node", "text").mapInArrow(_sets, "node long, items array<long>")
    sets = materialize(sets.dropDuplicates(["node"]), "sets")
    linked = _confirm(stars, sets, percent, "links")
    roots = materialize(components(linked), "roots")

    # Nodes that share a bucket with another component.
    placed = members.select("key", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    open_ = placed.join(apart, "key").select("node", "n", "root").distinct()
    rest = _across(open_, sets, percent).join(stars, ["a", "b"], "left_anti")
    more = _confirm(materialize(rest, "rest"), sets, percent, "more-links")
    every = roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
    roots = materialize(components(every), "roots")

    # The smallest document of each group, back to all documents of its sets.
    tied = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = tied.groupBy("root").agg(F.min("least").alias("group"))
    tied = tied.join(least, "root").select("f1", "f2", "group")
    return signs.join(tied, ["f1", "f2"], "left").select(
        "doc", "mark", "n", F.when(F.col("n") > 0, F.col("group")).alias("root"))


NO_ID = (1 << 63) - 1


def group_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """`docs` with `n_shingles`, `component_id` and `kept` (the first document of its group).

    `kept` marks one document of each group: that with the smallest id; among rows
    with one id that with the smallest text hash; of equal rows one. Texts without words
    are all kept.
    """
    others = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept")]
    named = docs.select(*[F.col(f"`{c}`") for c in others]).withColumns({
        "mh_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "mh_mark": F.md5(F.coalesce(text_col, F.lit("")))})
    groups = near_groups(named.select(
        F.col("mh_doc").alias("doc"), F.col("mh_mark").alias("mark"), F.col(text_col).alias("text")), percent)
    groups = groups.select(
        F.col("doc").alias("mh_doc"), F.col("mark").alias("mh_mark"), F.col("n").alias("n_shingles"),
        F.col("root").alias("mh_root")).distinct()
    groups = materialize(groups, "groups")
    # Rows of one group may share an id: one text is chosen, and of equal rows the first.
    first = groups.filter("mh_root IS NOT NULL").groupBy("mh_root").agg(
        F.min(F.struct("mh_doc", "mh_mark")).alias("mh_first"))
    groups = groups.join(first, "mh_root", "left")
    copy = F.row_number().over(W.partitionBy("mh_doc", "mh_mark").orderBy("mh_doc"))
    out = named.join(groups, ["mh_doc", "mh_mark"]).withColumn("mh_copy", copy)
    root = F.coalesce("mh_root", "mh_doc")
    group = F.when(root != NO_ID, root)
    chosen = F.col("mh_root").isNull() | (
        (F.col("mh_first.mh_doc") == F.col("mh_doc")) & (F.col("mh_first.mh_mark") == F.col("mh_mark")) & (F.col("mh_copy") == 1))
    return out.select(
        *[F.col(f"`{c}`") for c in others], "n_shingles", group.alias("component_id"),
        chosen.alias("kept"))
