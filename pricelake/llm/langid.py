"""Language identification with bit-sliced Bloom filters over byte n-grams.

Learning: 4-grams of bytes (ASCII letters lower-cased, other ASCII characters as space)
are counted per language; a language's filter holds those that make up at least
`MIN_SHARE` of its n-grams. So a filter has at most 1 / MIN_SHARE entries, whatever the
size of the corpus, and stray words of other languages stay out. All filters lie side
by side: one slot has one bit per language, so the bitwise AND of an n-gram's slots is
the set of all languages that contain it. The slot table has a fixed size and is all
that is sent to the tasks.

Deciding: per text and language the set bits are counted (hits). With a filter's fill
share f and K slots per n-gram, f^K of the absent n-grams hit by chance, so the
corrected count is (hits - n f^K) / (1 - f^K). The largest count wins, ties go to the
more frequent language; `score` is its share of all languages' counts.

Defined results: null texts and texts without a letter give `und` with score 0; texts
with letters but no known n-gram give the most frequent language with score 0; rows
without language teach nothing; nothing learnt gives `und` everywhere; repeated rows
give repeated results; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelake.llm import text as tx
from pricelake.session import materialize

GRAM = 4
MIN_SHARE = 2e-5
SLOT_BITS = 20
PROBES = 3
PLANE = 63  # languages per slot word
UND = "und"

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def _grams(block: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a block as integers, and bounds per row; each text has a space on both sides."""
    rows = len(block.ends) - 1
    size = np.diff(block.ends)
    padded = np.full(len(block.data) + 4 * rows, 32, np.uint8)
    padded[np.arange(len(block.data)) + np.repeat(4 * np.arange(rows) + 1, size)] = _KEEP[block.data]
    wide = padded.astype(np.uint32)
    grams = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24) if rows else wide
    # A text of n bytes has n + 1 n-grams between its spaces.
    first = block.ends[:-1] + 4 * np.arange(rows)
    keep = np.ones(len(grams), bool)
    for k in range(1, 4):
        ahead = first[1:] - k
        keep[ahead[ahead < len(grams)]] = False
    bounds = np.concatenate(([0], np.cumsum(size + 1)))
    return grams[keep][: bounds[-1]], bounds


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    mixed = tx.mix(grams.astype(np.uint64) + np.uint64(1))
    return [((mixed >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int32) for k in range(PROBES)]


BLANK = 0x20202020


def _count(batches):
    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            grams = np.concatenate([g for g, _ in parts])
            counts = np.concatenate([c for _, c in parts])
            grams, at = np.unique(grams, return_inverse=True)
            total = np.bincount(at, weights=counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(total)], ["lang", "gram", "n"])
        held.clear()

    for block in tx.blocks(batches, "text"):
        langs = np.array(block.batch.column(0).slice(block.first, block.last - block.first).to_pylist(), object)
        grams, bounds = _grams(block)
        owner = np.repeat(np.arange(len(langs)), np.diff(bounds))
        names, code = np.unique(langs.astype(str), return_inverse=True)
        of = code[owner]
        for k, name in enumerate(names):
            found, counts = np.unique(grams[of == k], return_counts=True)
            real = found != BLANK
            held.setdefault(str(name), []).append((found[real], counts[real]))
            size += len(found)
        if size > 2_000_000:
            yield from flush()
            size = 0
    yield from flush()


class Filters:
    """What was learnt: language names by frequency, slot words, fill shares."""

    def __init__(self, names: list[str], planes: np.ndarray):
        self.names, self.planes = names, planes
        self.fill = np.array([
            np.count_nonzero(planes[k // PLANE] >> np.uint64(k % PLANE) & np.uint64(1)) for k in range(len(names))
        ]) / (1 << SLOT_BITS)


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Filters:
    """Filters of all languages in `docs`."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    # One row per language.
    totals = sorted((-r.n, r.lang) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect())
    names = [lang for _, lang in totals]
    if not names:
        return Filters([], np.zeros((1, 1 << SLOT_BITS), np.uint64))
    table = rows.sparkSession.createDataFrame(
        [(lang, -n, i // PLANE, i % PLANE) for i, (n, lang) in enumerate(totals)], "lang string, total long, plane int, bit int")

    def slots(batches):
        for batch in batches:
            grams = batch.column(2).to_numpy().astype(np.uint32)
            for at in _slots(grams):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(at)], ["plane", "bit", "slot"])

    chosen = counts.join(table, "lang").filter(F.col("n") >= F.col("total") * MIN_SHARE).select("plane", "bit", "gram")
    words = chosen.mapInArrow(slots, "plane int, bit int, slot int").groupBy("plane", "slot").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")).toArrow()
    planes = np.zeros((-(-len(names) // PLANE), 1 << SLOT_BITS), np.uint64)
    planes[words.column("plane").to_numpy(), words.column("slot").to_numpy()] = words.column("word").to_numpy().astype(np.uint64)
    return Filters(names, planes)


def _lettered(block: tx.Block) -> np.ndarray:
    """Which rows have a letter."""
    ascii_letter = np.zeros(256, np.int64)
    ascii_letter[65:91] = ascii_letter[97:123] = 1
    sums = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[block.data])))[block.ends])
    found = sums(ascii_letter) > 0
    high = np.zeros(256, np.int64)
    high[128:] = 1
    for i in np.flatnonzero(~found & (sums(high) > 0)):
        text = block.data[block.ends[i]:block.ends[i + 1]].tobytes().decode("utf-8", "ignore")
        found[i] = any(c.isalpha() for c in text)
    return found


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score`."""
    names, fill = filters.names, filters.fill
    # Smallest type that holds a slot's bits: cache misses decide the speed.
    planes = [p.astype(np.uint8) if len(names) <= 8 else p for p in filters.planes]

    def decide(batches):
        for block in tx.blocks(batches, text_col):
            rows = block.last - block.first
            pred = np.full(rows, -1)
            score = np.zeros(rows)
            if names:
                grams, bounds = _grams(block)
                places = _slots(grams)
                hits = np.zeros((rows, len(names)))
                for p, plane in enumerate(planes):
                    mask = plane[places[0]]
                    for place in places[1:]:
                        mask = mask & plane[place]
                    for k in range(p * PLANE, min(len(names), (p + 1) * PLANE)):
                        bit = (mask >> plane.dtype.type(k % PLANE)) & plane.dtype.type(1)
                        hits[:, k] = np.add.reduceat(bit, bounds[:-1], dtype=np.int64)
                chance = fill ** PROBES
                counts = np.maximum(hits - np.diff(bounds)[:, None] * chance, 0) / np.maximum(1 - chance, 1e-9)
                total = counts.sum(axis=1)
                best = counts.argmax(axis=1)
                ok = _lettered(block)
                pred[ok] = best[ok]
                score = np.where(ok & (total > 0), counts[np.arange(rows), best] / np.maximum(total, 1e-9), 0.0)
            null = np.asarray(block.batch.column(block.batch.num_columns - 1).slice(block.first, rows).is_null())
            pred[null] = -1
            columns = [c.slice(block.first, rows) for c in block.batch.columns]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([UND if i < 0 else names[i] for i in pred], pa.string()), pa.array(score)],
                [*block.batch.schema.names, "lang_pred", "score"])

    taken = {"lang_pred", "score"}
    others = [c for c in docs.columns if c not in taken | {text_col}]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(decide, f"{schema}, lang_pred string, score double")
