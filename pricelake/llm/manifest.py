"""Merkle manifest of a dataset, kept as postorder logs.

A tree's leaves stand in order; while several nodes remain, every two consecutive ones
(the last may be alone) become the digest of their hex texts. Nodes are written to a log in
the order in which they are complete: a leaf, then every parent that it completes. So a
node's place needs no pointer. A full tree of height h has 2^(h+1) - 1 nodes, hence

    leaf i                     2 i - popcount(i)
    full node j at height h    place of its last leaf + h
    open node at height h      2 n - popcount(n) + its number among the open heights

(open: it covers fewer than 2^h leaves; there is at most one a height, and a log of n leaves
ends with them). A sibling's digest is read at its place.

Builders are aligned: one takes 2^BLOCK leaves that start at a multiple of 2^BLOCK, whose
nodes are consecutive in the log. The roots of a tier's blocks are the leaves of the next
tier, which has a log of its own, so no task ever holds more than 2^BLOCK leaves whatever a
tree's size, and full blocks never change when leaves are added at the end. Proofs are taken
the other way: a block hands its own path to its at most 2^BLOCK members.

Leaves are put in order by a range exchange on (tree, id, digest, row), which splits a tree
that holds most rows, and numbered by partition counts; no window runs over a whole tree.

Defined results: a null group is a group of its own, before all others; rows with equal ids
are ordered by digest, null ids come first; equal rows are leaves of their own (their proofs
may be exchanged between them); an empty table gives no rows and has no root; a lone leaf is
its tree's root and its proof is empty; a row whose field is null is marked by `-`. Texts of
any length are hashed whole in the JVM. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from pricelake.session import materialize

BLOCK = 10  # a builder takes 2^BLOCK leaves
HEX = 64

SEGMENTS = "tree string, tier int, block long, n long, pos long, root string, digests string"
PATHS = "tree string, block long, path string, sides string, subroot string, root string"


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of the fields, each `-` if null, else its UTF-8 byte count, `:` and its text."""
    def part(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(f) for f in fields]), 256)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def width(n: int, height: int) -> int:
    """Nodes at a height of a tree of n leaves."""
    return -(-n >> height)


def place(n: int, height: int, index: int) -> int:
    """Place of a node in the log of n leaves."""
    if (index + 1) << height <= n:
        last = ((index + 1) << height) - 1
        return 2 * last - last.bit_count() + height
    opened = (n & -n).bit_length()  # the lowest open height
    return 2 * n - n.bit_count() + height - opened


def write_block(leaves: list[str], n: int, size: int = BLOCK) -> list[str]:
    """Digests of one aligned block in order of completion; `n` leaves in the whole tree, 2^size a block."""
    log: list[str] = []
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        height = 0
        while i >> height & 1:
            # The left sibling stands before the full right tree.
            log.append(_sha(log[len(log) - (2 << height)] + log[-1]))
            height += 1
    m = len(leaves)
    for height in range(1, _top(n, size) + 1):
        if m >> height << height != m:
            last = width(m, height - 1) - 1
            children = [log[place(m, height - 1, k)] for k in (last - 1, last) if k >> 1 == last >> 1 and k >= 0]
            log.append(_sha("".join(children)))
    return log


def height_of(n: int) -> int:
    return max(n - 1, 0).bit_length()


def _path(log: list[str], m: int, top: int, index: int) -> tuple[str, str]:
    """Siblings of leaf `index` of a block of m leaves from below, and a letter a level: which side it has."""
    path, sides = [], []
    for height in range(top):
        sibling = (index >> height) ^ 1
        if sibling < width(m, height):
            path.append(log[place(m, height, sibling)])
            sides.append("l" if sibling & 1 == 0 else "r")
        else:
            sides.append("-")
    return "".join(path), "".join(sides)


def fold(leaf: str, path: str, sides: str) -> str:
    """The root that follows from a leaf and its siblings."""
    at = 0
    for side in sides:
        if side == "-":
            leaf = _sha(leaf)
            continue
        sibling = path[at : at + HEX]
        at += HEX
        leaf = _sha(sibling + leaf if side == "l" else leaf + sibling)
    return leaf


def number_rows(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds `idx`, the place of a row within its tree by `order`, and `n`, the tree's rows.

    The exchange is by range over (tree, order), so a large tree lies in many partitions.
    `order` must end with a column that is unique.
    """
    lined = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    lined = materialize(lined.withColumn("__seq", F.monotonically_increasing_id()), "lined")
    lined = lined.withColumn("__part", F.shiftright("__seq", 33))
    parts = lined.groupBy(tree, "__part").agg(F.count(F.lit(1)).alias("__rows"), F.min("__seq").alias("__from"))
    before = W.partitionBy(tree).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({
        "__base": F.coalesce(F.sum("__rows").over(before), F.lit(0)),
        "n": F.sum("__rows").over(W.partitionBy(tree))}).drop("__rows")
    out = lined.join(parts, [tree, "__part"])
    return out.withColumn("idx", F.col("__base") + F.col("__seq") - F.col("__from")).drop(
        "__seq", "__part", "__base", "__from")


def _each(batches):
    """Rows one by one: a row is a whole block, so a batch of them is not turned into objects at once."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(zip(*rows), schema)], [name for name, _ in schema])


TEXT, LONG = pa.string(), pa.int64()


def _segments(tier: int, size: int):
    schema = [("tree", TEXT), ("tier", pa.int32()), ("block", LONG), ("n", LONG), ("pos", LONG), ("root", TEXT),
              ("digests", TEXT)]

    def write(batches):
        for row in _each(batches):
            log = write_block([e["digest"] for e in row["members"]], row["n"], size)
            first = row["block"] << size
            yield _batch([(row["tree"], tier, row["block"], row["n"], 2 * first - first.bit_count(), log[-1],
                           "".join(log))], schema)

    return write


def build_logs(leaves: DataFrame, size: int = BLOCK) -> list[DataFrame]:
    """Stored log segments of all trees of `leaves` (tree, idx, n, digest), a table a tier.

    A segment (tree, tier, block, n, pos, root, digests) holds the nodes of one aligned block in
    order of completion; `pos` is the place of its first in the tier's log, `n` the tier's leaves.
    """
    tiers = []
    while True:
        tier = len(tiers)
        blocks = leaves.groupBy("tree", F.shiftright("idx", size).alias("block")).agg(
            F.max("n").alias("n"),
            F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("members"))
        tiers.append(materialize(blocks.mapInArrow(_segments(tier, size), SEGMENTS), f"log-{tier}"))
        # Trees of several blocks go on.
        more = tiers[-1].filter(F.col("n") > 1 << size)
        if more.isEmpty():
            return tiers
        leaves = more.select(
            "tree", F.col("block").alias("idx"), F.ceil(F.col("n") / (1 << size)).alias("n"), F.col("root").alias("digest"))


def roots(tiers: list[DataFrame], size: int = BLOCK) -> DataFrame:
    """(tree, root) of every tree."""
    tops = [t.filter(F.col("n") <= 1 << size).select("tree", "root") for t in tiers]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def _top(n: int, size: int) -> int:
    return height_of(n) if n <= 1 << size else size


def _unpack(digests: str) -> list[str]:
    return [digests[k : k + HEX] for k in range(0, len(digests), HEX)]


def _paths_in(row: dict, size: int):
    """(member, path, sides) of all members of a block, from its log."""
    log, n = _unpack(row["digests"]), row["n"]
    m, top = min(n - (row["block"] << size), 1 << size), _top(n, size)
    for k in range(m):
        path, sides = _path(log, m, top, k)
        yield k, path + row["path"], sides + row["sides"]


def _hand_down(size: int):
    """A block's path goes to its members."""
    schema = [("tree", TEXT), ("block", LONG), ("path", TEXT), ("sides", TEXT), ("subroot", TEXT), ("root", TEXT)]

    def extract(batches):
        for row in _each(batches):
            first = row["block"] << size
            yield _batch([(row["tree"], first + k, path, sides, row["subroot"], row["root"])
                          for k, path, sides in _paths_in(row, size)], schema)

    return extract


def paths_of_blocks(tiers: list[DataFrame], above: DataFrame, size: int = BLOCK) -> DataFrame:
    """Path of every block of the lowest tier: (tree, block, path, sides, subroot, root).

    `above` (tree, path, sides, subroot, root) is the path from a tree's root on.
    """
    found = None
    for tier in reversed(tiers):
        # A tree ends at the tier that has one block of it.
        ends = tier.filter(F.col("n") <= 1 << size).select("tree", "block").join(above, "tree")
        ends = ends.select("tree", "block", "path", "sides", "subroot", "root")
        found = ends if found is None else ends.unionByName(found)
        if tier is not tiers[0]:
            inner = tier.select("tree", "block", "n", "digests").join(found, ["tree", "block"])
            found = materialize(inner.mapInArrow(_hand_down(size), PATHS), "paths")
    return found


def _prove(size: int):
    schema = [("id", LONG), ("leaf", TEXT), ("subroot", TEXT), ("root", TEXT), ("proof", TEXT), ("sides", TEXT),
              ("folded_root", TEXT), ("verified", pa.bool_())]

    def prove(batches):
        for row in _each(batches):
            out = []
            for k, path, sides in _paths_in(row, size):
                member = row["members"][k]
                folded = fold(member["claimed"] or member["digest"], path, sides)
                out.append((member["id"], member["digest"], row["subroot"], row["root"], path, sides, folded,
                            folded == row["root"]))
            yield _batch(out, schema)

    return prove


def prove_all(leaves: DataFrame, size: int = BLOCK) -> DataFrame:
    """Proof of every leaf, and what its claimed digest folds to.

    `leaves` has `tree` (sorts as its group does), `id`, `digest` and `claimed` (the digest
    that a holder presents, null: the same). Trees' roots are the leaves of one more tree.
    Returns id, leaf, subroot (its tree's), root (of all), proof (hex digests of the
    siblings from below), sides (a letter a level: l, r, or - where the node is alone),
    folded_root and verified.
    """
    leaves = leaves.select("tree", "id", "digest", "claimed")
    leaves = materialize(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    numbered = materialize(number_rows(leaves, "tree", ["id", "digest", "row"]), "numbered")
    tiers = build_logs(numbered, size)
    subroots = roots(tiers, size).select(F.lit("").alias("all"), "tree", F.col("root").alias("digest"))
    outer = number_rows(subroots, "all", ["tree"])
    outer = materialize(outer, "subroots")
    outer_tiers = build_logs(outer.select(F.col("all").alias("tree"), "idx", "n", "digest"), size)
    whole = roots(outer_tiers, size)
    start = whole.select("tree", F.lit("").alias("path"), F.lit("").alias("sides"), F.lit("").alias("subroot"), "root")
    outer_blocks = paths_of_blocks(outer_tiers, start, size)
    outer_paths = outer_tiers[0].select("tree", "block", "n", "digests").join(outer_blocks, ["tree", "block"])
    outer_paths = materialize(outer_paths.mapInArrow(_hand_down(size), PATHS), "outer-paths")
    above = outer.join(outer_paths.select(F.col("block").alias("idx"), "path", "sides", "root"), "idx").select(
        "tree", "path", "sides", F.col("digest").alias("subroot"), "root")

    blocks = paths_of_blocks(tiers, above, size)
    members = numbered.groupBy("tree", F.shiftright("idx", size).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "id", "digest", "claimed"))).alias("members"))
    ready = members.join(tiers[0].select("tree", "block", "n", "digests"), ["tree", "block"]).join(
        blocks, ["tree", "block"])
    return ready.mapInArrow(
        _prove(size), "id long, leaf string, subroot string, root string, proof string, sides string, "
        "folded_root string, verified boolean")


def tree_key(group: Column) -> Column:
    """A text that sorts as the group does by UTF-8 bytes, with null before all."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))
