"""Removal of long byte strings that occur more than once, by column-wise suffix order.

A byte goes if a `length`-byte string that covers it also starts at another place, in
the same text or another. Strings never cross texts and are judged on the input.

1. Every `length`-byte window names one anchor: the `GRAM`-byte string inside it whose
   hash is smallest (leftmost if equal). Equal windows name the same anchor at the same
   place, so only windows with one anchor string need comparing. Consecutive windows
   with the same anchor form a segment; about one anchor stands for 100 windows.
2. Segments are counted by anchor string, then by content (hash aggregations with
   map-side combine, so a passage in a third of all texts is no hot task). Segments
   with the same anchor and content repeat as a whole. Where one anchor string has
   several contents, one segment of each goes on.
3. Their suffixes are ordered column by column, as in multi-text construction of a
   Burrows-Wheeler transform: aligned at the anchor, each round inserts the next symbol
   to the left of every segment, re-orders by a stable counting sort and updates the
   lengths of common prefixes from those of the round before. A window repeats if the
   common prefix with a neighbour reaches `length`. The rounds are bounded by the segment
   length (2 * length - GRAM), not by the longest text, and a block of segments streams
   through a task at a time.
4. An anchor string with more than `HOT` contents is not brought together; its windows
   are counted by their own hash instead, again with map-side combine.

Defined results: null and empty texts have no bytes and lose none; texts shorter than
`length` lose nothing; rows with equal ids are separate texts; two equal rows count as two
places, so they lose all bytes of texts of at least `length` bytes; extra columns pass
through, those named as a result are replaced. Text of any length is cut into pieces that share length - 1 bytes, so no
window is missed and memory does not depend on the longest text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricelake.llm import text as tx
from pricelake.session import materialize

LENGTH = 400
GRAM_SHARE = 2  # an anchor is length / GRAM_SHARE bytes
HOT = 20_000
OFTEN_TIMES = 4096  # bodies beyond it are joined apart: at most one in so many rows
ORDER_ROWS = 8192
PIECE_BYTES = 1 << 20
_PLACE = np.uint64((1 << 23) - 1)

ANCHORS = "doc long, mark long, key long, body long, at long, off int, n int"
SEGMENTS = "doc long, mark long, s long, e long"


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(row, key, body, first window, anchor - first window, windows) of every segment."""
    n = len(data)
    empty = [np.zeros(0, np.int64)] * 6
    if n < length:
        return empty
    sums = tx.prefix_sums(tx.BYTE_CODES[data])
    every = np.arange(n - gram + 1)
    grams = tx.span_hash(sums, every, every + gram)
    low = _window_min((grams & ~_PLACE) | every.astype(np.uint64), length - gram + 1)
    step = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(ends) >= length)
    if not len(long):
        return empty
    step[ends[long]] = 1
    step[ends[long + 1] - length + 1] = -1
    starts = np.flatnonzero(np.cumsum(step[:-1], dtype=np.int8))
    place = (low[starts] & _PLACE).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate(
        ([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))))
    lo, hi = starts[fresh], starts[np.append(fresh[1:], len(starts)) - 1]
    anchor = place[fresh]
    row = np.searchsorted(ends, lo, side="right") - 1
    body = tx.span_hash(sums, lo, hi + length)
    return row, grams[anchor].view(np.int64), body.view(np.int64), lo - ends[row], anchor - lo, hi - lo + 1


def _cut(block: tx.Block, length: int):
    """The block's texts as pieces of bounded size: (data, ends, row of each piece, its place in the text)."""
    if len(block.data) <= PIECE_BYTES:
        yield block.data, block.ends, np.arange(len(block.ends) - 1), np.zeros(len(block.ends) - 1, np.int64)
        return
    for row in range(len(block.ends) - 1):
        a, b = block.ends[row], block.ends[row + 1]
        for at in range(0, max(1, b - a - length + 1), PIECE_BYTES):
            part = block.data[a + at : min(b, a + at + PIECE_BYTES + length - 1)]
            yield part, np.array([0, len(part)]), np.array([row]), np.array([at])


def _scan(length: int, gram: int):
    def scan(batches):
        for block in tx.blocks(batches, "text", tx.SMALL_BLOCK_BYTES):
            ids = block.batch.column(0).slice(block.first, block.last - block.first)
            marks = block.batch.column(1).slice(block.first, block.last - block.first)
            for data, ends, rows, places in _cut(block, length):
                row, key, body, at, off, n = anchors_of(data, ends, length, gram)
                if len(row):
                    pick = pa.array(rows[row])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pick), marks.take(pick), pa.array(key), pa.array(body), pa.array(at + places[row]),
                         pa.array(off.astype(np.int32)), pa.array(n.astype(np.int32))],
                        ["doc", "mark", "key", "body", "at", "off", "n"])

    return scan


def repeated_starts(data: np.ndarray, ends: np.ndarray, group: np.ndarray, off: np.ndarray, length: int, gram: int):
    """For aligned segments, sorted by group: flags [segment, k], window k starts k bytes into the segment.

    `off` is where the segment's anchor stands. One round per column, from the right.
    """
    rows = len(group)
    reach = length - gram  # windows start up to so far left of the anchor
    flags = np.zeros((rows, reach + 1), bool)
    base = ends[:-1] + off
    size = np.diff(ends)
    order = np.arange(rows)
    common = np.zeros(rows + 1, np.int32)  # with the one before in order; the last entry is a stop
    kind = np.unique(group, return_inverse=True)[1]
    kind = kind.astype(np.uint16) if rows < 65536 else kind
    for column in range(length - 1, -reach - 1, -1):
        place = off + column
        here = (place >= 0) & (place < size)
        if not here.any():
            continue
        symbol = np.where(here, data[np.where(here, base + column, 0)].astype(np.uint16) + 1, 0).astype(np.uint16)
        # Stable sorts by symbol, then group, of the former order.
        old = np.argsort(symbol[order], kind="stable")
        old = old[np.argsort(kind[order[old]], kind="stable")]
        fresh = order[old]
        sym, grp = symbol[fresh], kind[fresh]
        grown = np.zeros(rows + 1, np.int32)
        same = np.flatnonzero((sym[1:] == sym[:-1]) & (grp[1:] == grp[:-1]) & (sym[1:] > 0)) + 1
        if len(same):
            # Least common prefix of all that stood between the two.
            pairs = np.empty(2 * len(same), np.int64)
            pairs[0::2], pairs[1::2] = old[same - 1] + 1, old[same] + 1
            grown[same] = 1 + np.minimum.reduceat(common, pairs)[0::2]
        order, common = fresh, grown
        if column <= 0:
            twin = np.maximum(common[:-1], common[1:]) >= length
            hit = order[twin]
            flags[hit, off[hit] + column] = True
    return flags


def _spans(flags: np.ndarray, length: int):
    """(segment, first byte, end) of maximal runs of flagged windows."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    turn = np.diff(padded, axis=1)
    row, start = np.nonzero(turn == 1)
    _, stop = np.nonzero(turn == -1)
    return row, start, stop - 1 + length


def _compare(length: int, gram: int, order_rows: int):
    def emit(table: pa.Table):
        block = next(tx.blocks(table.combine_chunks().to_batches(max_chunksize=None), "bytes", 1 << 40))
        column = lambda name: block.batch.column(block.batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        flags = repeated_starts(block.data, block.ends, column("key"), column("off").astype(np.int64), length, gram)
        flags &= column("lone")[:, None]
        row, start, stop = _spans(flags, length)
        if len(row):
            at = column("at")[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column("doc")[row]), pa.array(column("mark")[row]), pa.array(at + start), pa.array(at + stop)],
                ["doc", "mark", "s", "e"])

    def compare(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= order_rows:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                # The last anchor string may go on in the next batch.
                cut = int(np.searchsorted(keys, keys[-1], side="left"))
                if cut:
                    yield from emit(table.slice(0, cut))
                    rest = table.slice(cut)
                    held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield from emit(pa.Table.from_batches(held))

    return compare


def repeated_spans(
    docs: DataFrame,
    length: int = LENGTH,
    hot: int = HOT,
    order_rows: int = ORDER_ROWS,
    gram: int | None = None,
    often_times: int = OFTEN_TIMES,
) -> DataFrame:
    """Spans (doc, mark, s, e) of `docs` (doc, mark, text) that repeated windows cover; they may overlap.

    `gram` is the length of an anchor: a shorter one leaves fewer segments, but more that share an anchor by chance.
    """
    gram = gram or length // GRAM_SHARE
    anchors = materialize(docs.select("doc", "mark", "text").mapInArrow(_scan(length, gram), ANCHORS), "anchors")
    # Stored, so that the join has an exchange on both sides and can split a common key.
    often = materialize(
        anchors.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key"), "often")
    shared = materialize(anchors.join(often, "key"), "shared-anchors")
    bodies = materialize(shared.groupBy("key", "body").agg(
        F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("doc", "mark", "at", "off", "n")]), "bodies")
    # A body that stands in very many places has few rows here, so its places need not be brought together.
    frequent = materialize(bodies.filter(F.col("times") > often_times).select("key", "body"), "frequent")
    repeated = bodies.filter((F.col("times") > 1) & (F.col("times") <= often_times)).select("key", "body")
    span = ["doc", "mark", F.col("at").alias("s"), (F.col("at") + F.col("n") - 1 + length).alias("e")]
    whole = shared.join(frequent, ["key", "body"]).select(*span).unionByName(
        shared.join(frequent, ["key", "body"], "left_anti").join(repeated, ["key", "body"]).select(*span))

    mixed = materialize(bodies.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "mixed")
    rivals = bodies.join(mixed, "key").select(
        "key", "doc", "mark", "at", "off", "n", "kinds", (F.col("times") == 1).alias("lone"))
    texts = docs.select("doc", "mark", F.col("text").cast("binary").alias("raw"))
    cut = F.substring(F.col("raw"), (F.col("at") + 1).cast("int"), F.col("n") + length - 1)
    rivals = materialize(
        texts.join(rivals, ["doc", "mark"]).select(
            "key", "doc", "mark", "at", "off", "kinds", "lone", cut.alias("bytes")).dropDuplicates(
                ["key", "doc", "mark", "at"]), "rivals")
    ordered = rivals.filter(F.col("kinds") <= hot).repartition("key").sortWithinPartitions("key")
    partly = ordered.mapInArrow(_compare(length, gram, order_rows), SEGMENTS)

    # Windows of very common anchors, by their own content.
    windows = rivals.filter(F.col("kinds") > hot).select(
        "doc", "mark", "lone", F.col("at"), F.col("bytes"),
        F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("k"))
    windows = windows.select(
        "doc", "mark", "lone", (F.col("at") + F.col("k")).alias("s"),
        F.sha2(F.substring(F.col("bytes"), F.col("k") + 1, F.lit(length)), 256).alias("window"))
    known = windows.groupBy("window").agg(F.count("*").alias("times")).filter("times > 1").select("window")
    common = windows.filter("lone").join(known, "window").select(
        "doc", "mark", "s", (F.col("s") + length).alias("e"))
    return whole.unionByName(partly).unionByName(common)


RUNS = "array<struct<s:bigint,e:bigint>>"


def _merged(spans: Column) -> Column:
    """Maximal runs of spans that are sorted by their start; spans that touch become one."""
    def step(acc, span):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(
            F.struct(last["s"].alias("s"), F.greatest(last["e"], span["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (span["s"] <= F.try_element_at(acc, F.lit(-1))["e"]), joined).otherwise(
            F.concat(acc, F.array(F.struct(span["s"].alias("s"), span["e"].alias("e")))))

    return F.aggregate(spans, F.array().cast(RUNS), step)


def _inside_character(raw: Column, at: Column) -> Column:
    """Whether the byte at a place continues a UTF-8 character."""
    return F.coalesce(F.hex(F.substring(raw, (at + 1).cast("int"), F.lit(1))).between("80", "BF"), F.lit(False))


def _whole_characters(raw: Column, runs: Column) -> Column:
    """Runs that end inside a character take the rest of it as well."""
    def grown(run):
        left = F.when(~_inside_character(raw, run["s"]), 0)
        right = F.when(~_inside_character(raw, run["e"]), 0)
        for k in (1, 2):
            left = left.when(~_inside_character(raw, run["s"] - k), k)
            right = right.when(~_inside_character(raw, run["e"] + k), k)
        return F.struct((run["s"] - left.otherwise(3)).alias("s"), (run["e"] + right.otherwise(3)).alias("e"))

    return _merged(F.transform(runs, grown))


def strip_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    whole_characters: bool = False,
    keep: Callable[[Column, Column], Column] | None = None,
    **settings,
) -> DataFrame:
    """`docs` with `kept` (remaining bytes), `n_bytes`, `n_removed` and `n_spans`.

    With `whole_characters` a run also takes the rest of a character that it would cut in two.
    `keep` maps a run's bytes and their number to whether it stays in the text all the same.
    """
    # 128 bits tell a row from others, whatever its id; equal rows share them, and their spans.
    identity = [F.col(id_col), F.col(text_col)]
    named = docs.withColumns({
        "sx_doc": F.xxhash64(F.lit("doc"), *identity), "sx_mark": F.xxhash64(F.lit("mark"), *identity)})
    spans = repeated_spans(named.select(
        F.col("sx_doc").alias("doc"), F.col("sx_mark").alias("mark"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")), length, **settings)
    lists = spans.groupBy("doc", "mark").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))
    lists = lists.select(
        F.col("doc").alias("sx_doc"), F.col("mark").alias("sx_mark"), _merged(F.col("spans")).alias("sx_runs"))
    out = named.join(lists, ["sx_doc", "sx_mark"], "left").withColumn(
        "sx_raw", F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    raw = F.col("sx_raw")
    part = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))
    runs = F.coalesce("sx_runs", F.array().cast(RUNS))
    if whole_characters:
        runs = _whole_characters(raw, runs)
    if keep is not None:
        runs = F.filter(runs, lambda run: ~keep(part(run["s"], run["e"]), run["e"] - run["s"]))
    out = out.withColumn("sx_runs", F.when(F.col("sx_runs").isNotNull(), runs))
    cut = F.when(F.size("sx_runs") > 0, F.col("sx_runs"))
    size = F.octet_length(raw).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(b"").alias("rest"))
    front = F.aggregate(cut, start, lambda acc, run: F.struct(
        run["e"].alias("end"), F.concat(acc["rest"], part(acc["end"], run["s"])).alias("rest")))
    gone = F.aggregate(cut, F.lit(0).cast("long"), lambda acc, run: acc + run["e"] - run["s"])
    others = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    return out.select(
        *[F.col(f"`{c}`") for c in others],
        F.when(cut.isNull(), raw).otherwise(F.concat(front["rest"], part(front["end"], size))).alias("kept"),
        size.alias("n_bytes"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_spans"))
