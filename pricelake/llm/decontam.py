"""Benchmark decontamination by canonical templates.

Tokens are words without outer ASCII punctuation, lower-cased (letters whose small form
takes as many UTF-8 bytes; a few such as the dotted capital I stay). Numbers (also as
words), units after a number, and names (capitalised, not at the start of a sentence)
become typed placeholders; what they replaced is the slot value. Windows of `WIDTH` template tokens of
benchmark items and documents are joined by hash, in two views: with and without name
placeholders, so that a change of case hides nothing. A window of mostly placeholders
says nothing and is left out, at least half of it must be plain tokens.

Matches of one document and item at one alignment are put together, from both views. They are
consistent if one slot value of the item always meets the same value of the document,
so a re-parameterised question (other numbers or names throughout) is caught, and a
mere likeness of templates with jumbled slots is not. An item is found if consistent
matches cover `COVER` of its tokens.

Documents are read once. A bitmap of fixed size over the benchmark's window hashes
goes to the tasks; only windows that pass it enter the join. The benchmark is never
collected; if it is large, the bitmap fills up and more windows take part in the join.

Defined results: null and empty texts match nothing; an item without a token is never
found; an item shorter than a window is one window of its own length; equal items are
reported each; repeated rows and rows with equal ids count as separate texts in the
matching (by id and text hash); null ids stay null; empty tables give an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricelake.llm import text as tx
from pricelake.session import materialize

WIDTH = 8
COVER = 0.5
BITMAP_BITS = 23
NUMBER, UNIT, NAME = 1, 2, 3
VIEWS = (NAME, 0)  # the kind that a view adds to numbers and units

# Number words and units, English.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "% percent mm cm m km inch inches foot feet yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs "
    "pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years mph kmh dollar dollars cent cents euro euros"
).split()

_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[33, 46, 63, 58]] = True
_OUTER = np.zeros(256, bool)
_OUTER[[c for c in range(33, 127) if not chr(c).isalnum() and c != 37]] = True


def _small_letters() -> np.ndarray:
    """By code point up to 0xFFFF: the lower-case code point, if it is one and as long in UTF-8."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for point in range(1 << 16):
        small = chr(point).lower()
        if len(small) == 1 and (ord(small) < 0x80) == (point < 0x80) and (ord(small) < 0x800) == (point < 0x800):
            table[point] = ord(small)
    return table


_SMALL = _small_letters()


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with letters lower-cased in place."""
    out = tx.LOWER[data]
    two = np.flatnonzero((data >= 0xC0) & (data < 0xE0))
    if len(two):
        small = _SMALL[(data[two] & 31).astype(np.uint32) << 6 | data[two + 1] & 63]
        out[two], out[two + 1] = 0xC0 | small >> 6, 0x80 | small & 63
    three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
    if len(three):
        point = (data[three] & 15).astype(np.uint32) << 12 | (data[three + 1] & 63).astype(np.uint32) << 6 | data[three + 2] & 63
        small = _SMALL[point]
        out[three], out[three + 1], out[three + 2] = 0xE0 | small >> 12, 0x80 | small >> 6 & 63, 0x80 | small & 63
    return out


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.concatenate(([0], np.cumsum([len(w.encode()) for w in words])))
    return np.sort(tx.span_hash(tx.prefix_sums(tx.BYTE_CODES[data]), ends[:-1], ends[1:]))


_NUMBER_HASHES, _UNIT_HASHES = _hash_words(NUMBER_WORDS), _hash_words(UNITS)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


class Tokens:
    """Tokens of a block: `bounds` per row, `word` hash and `kind` of each."""

    def __init__(self, block: tx.Block):
        data = block.data
        low = lower(data)
        starts, stops, bounds = tx.words(data, block.ends)
        raw_stops = stops
        # Outer punctuation: on to the first and back to the last byte that is none.
        solid = np.flatnonzero(~_OUTER[data])
        around = np.concatenate(([-1], solid, [len(data)]))
        starts = np.minimum(around[np.searchsorted(solid, starts) + 1], stops)
        stops = np.maximum(around[np.searchsorted(solid, stops)] + 1, starts)
        keep = starts < stops
        kept = np.concatenate(([0], np.cumsum(keep)))
        # A sentence starts with a text, after a closing mark or a line break.
        opens = np.ones(len(starts), bool)
        if len(starts) > 1:
            broken = np.concatenate(([0], np.cumsum((data == 10) | (data == 13))))
            opens[1:] = _SENTENCE_END[data[raw_stops[:-1] - 1]] | (broken[starts[1:]] > broken[raw_stops[:-1]])
            inner = bounds[1:-1]
            opens[inner[inner < len(starts)]] = True
        starts, stops, opens = starts[keep], stops[keep], opens[keep]
        self.bounds = kept[bounds]
        self.word = tx.span_hash(tx.prefix_sums(tx.BYTE_CODES[low]), starts, stops)
        self.kind = np.zeros(len(starts), np.int8)
        if not len(starts):
            return
        first = data[starts]
        # A letter is a capital if lower-casing changes one of its bytes.
        changed = np.concatenate(([0], np.cumsum(low != data)))
        second = np.minimum(starts + 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0), stops)
        lead = data[np.minimum(second, stops - 1)]
        after_second = np.minimum(second + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), stops)
        capital = changed[second] > changed[starts]
        lone = (second == stops) | (changed[after_second] > changed[second])
        self.kind[capital & ~lone & ~opens] = NAME
        number = ((first >= 48) & (first <= 57)) | _among(self.word, _NUMBER_HASHES)
        after = np.zeros(len(starts), bool)
        after[1:] = number[:-1]
        inner = self.bounds[1:-1]
        after[inner[inner < len(starts)]] = False
        self.kind[after & _among(self.word, _UNIT_HASHES)] = UNIT
        self.kind[number] = NUMBER

    def windows(self, view: int, width: int, exact: bool = False):
        """(row, first token, hash) of each telling window; `exact`: only of rows with `width` tokens."""
        code = self.word.copy()
        slot = (self.kind == NUMBER) | (self.kind == UNIT) | (self.kind == view) & (view > 0)
        code[slot] = tx.mix(self.kind[slot].astype(np.uint64) + np.uint64(1 << 20))
        count = np.diff(self.bounds)
        full = np.where(count == width, 1, 0) if exact else np.maximum(count - width + 1, 0)
        ends = np.concatenate(([0], np.cumsum(full)))
        row = np.repeat(np.arange(len(full)), full)
        first = np.arange(ends[-1]) + np.repeat(self.bounds[:-1] - ends[:-1], full)
        slots = np.concatenate(([0], np.cumsum(slot)))
        telling = (slots[first + width] - slots[first]) * 2 <= width
        row, first = row[telling], first[telling]
        hashes = tx.span_hash(tx.prefix_sums(code), first, first + width)
        return row, first, tx.mix(hashes + np.uint64(view * 1000 + width))


FOUND = "id {id}, mark string, hash long, view int, at int, words array<long>, kinds array<tinyint>, size int"


def _rows(block: tx.Block, tokens: Tokens, parts: list) -> pa.RecordBatch:
    """Window rows (row, first, hash, view, width) with their tokens."""
    row, first, hashes, view, width = (np.concatenate([p[k] for p in parts]) for k in range(5))
    order = np.repeat(first, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    offsets = pa.array(np.concatenate(([0], np.cumsum(width))).astype(np.int32))
    pick = pa.array(row + block.first)
    lists = lambda v: pa.ListArray.from_arrays(offsets, pa.array(v))
    return pa.RecordBatch.from_arrays(
        [block.batch.column(0).take(pick), block.batch.column(1).take(pick), pa.array(hashes.view(np.int64)),
         pa.array(view.astype(np.int32)), pa.array((first - tokens.bounds[row]).astype(np.int32)),
         lists(tokens.word.view(np.int64)[order]), lists(tokens.kind[order]),
         pa.array(np.diff(tokens.bounds)[row].astype(np.int32))],
        ["id", "mark", "hash", "view", "at", "words", "kinds", "size"])


def _part(found, view: int, width: int):
    row, first, hashes = found
    return row, first, hashes, np.full(len(row), view), np.full(len(row), width)


def _item_windows(batches):
    for block in tx.blocks(batches, "text"):
        tokens = Tokens(block)
        parts = [_part(tokens.windows(v, WIDTH), v, WIDTH) for v in VIEWS]
        parts += [_part(tokens.windows(v, w, exact=True), v, w) for v in VIEWS for w in range(1, WIDTH)]
        yield _rows(block, tokens, parts)


def _document_windows(bitmap: np.ndarray, widths: list[int]):
    def scan(batches):
        for block in tx.blocks(batches, "text"):
            tokens = Tokens(block)
            parts = []
            for view in VIEWS:
                for width in widths:
                    row, first, hashes = tokens.windows(view, width)
                    place = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    hit = (bitmap[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                    parts.append(_part((row[hit], first[hit], hashes[hit]), view, width))
            if sum(len(p[0]) for p in parts):
                yield _rows(block, tokens, parts)

    return scan


def _mark(text_col: str) -> Column:
    """128 bits of a text, which tell rows with equal or null ids apart."""
    return F.md5(F.coalesce(text_col, F.lit("")))


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), _mark(text_col).alias("mark"), F.col(text_col).alias("text"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    cover: float = COVER,
) -> DataFrame:
    """One row per document and item found in it: id, mark (hash of the text), item, covered, size, same_slots."""
    named, items = _named(docs, id_col, text_col), _named(benchmark, item_col, item_text_col)
    kind = lambda df: df.schema["id"].dataType.simpleString()
    known = materialize(items.mapInArrow(_item_windows, FOUND.format(id=kind(items))), "items")
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    # At most 2^17 words of 64 bits, however large the benchmark is.
    bits = known.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITMAP_BITS}) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bitmap[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    widths = sorted(r[0] for r in known.select(F.size("words")).distinct().collect())  # 1..WIDTH

    found = named.mapInArrow(_document_windows(bitmap, widths), FOUND.format(id=kind(named)))
    theirs = known.select(
        "hash", "view", F.col("id").alias("item"), F.col("mark").alias("item_mark"), F.col("at").alias("item_at"),
        F.col("words").alias("item_words"), F.col("kinds").alias("item_kinds"), F.col("size").alias("item_size"))
    pairs = found.join(theirs, ["hash", "view"]).filter("kinds = item_kinds OR view = 0")
    # One row per token of a match; tokens that windows share fall together.
    cells = pairs.select(
        "id", "mark", "item", "item_mark", "item_size", (F.col("at") - F.col("item_at")).alias("shift"), "item_at",
        F.posexplode(F.arrays_zip("words", "item_words", "item_kinds")).alias("k", "cell"))
    # Both views of an alignment are judged together: a window without the name shows a number's value, one
    # with it the name's. Where a name is matched as a word, it meets itself.
    slot = F.when(F.col("cell.item_kinds").isin(NUMBER, UNIT, NAME), 1)
    key = ["id", "mark", "item", "item_mark", "item_size", "shift"]
    cells = cells.groupBy(*key, (F.col("item_at") + F.col("k")).alias("place")).agg(
        F.max(slot).alias("slot"), F.max("cell.words").alias("mine"), F.max("cell.item_words").alias("other"))
    other = F.when(F.col("slot") == 1, F.col("other"))
    matches = cells.groupBy(*key).agg(
        F.count("*").alias("covered"), F.count_distinct(other).alias("values"),
        F.count_distinct(other, F.when(F.col("slot") == 1, F.col("mine"))).alias("meetings"),
        F.count(F.when((F.col("slot") == 1) & (F.col("mine") == F.col("other")), 1)).alias("same_slots"))
    good = matches.filter((F.col("values") == F.col("meetings")) & (F.col("covered") >= F.col("item_size") * cover))
    return good.groupBy("id", "mark", "item").agg(
        F.max("covered").cast("long").alias("covered"), F.max("item_size").cast("long").alias("size"),
        F.max("same_slots").cast("long").alias("same_slots"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """`docs` without the documents in which an item was found."""
    hits = contaminated(docs, benchmark, id_col, text_col, **settings).select(
        F.col("id").alias("dc_id"), F.col("mark").alias("dc_mark")).distinct()
    return docs.join(
        hits, F.col(id_col).eqNullSafe(F.col("dc_id")) & (_mark(text_col) == F.col("dc_mark")), "left_anti")
