"""Spelling variants: words of a corpus at distance one, by a bit-sliced position index.

1. Words. Maximal runs of letters of all texts, with A-Z in lower case, are counted per Arrow
   batch and summed after that; the vocabulary is what occurs `least` times or more.
2. Index. For every (position, letter) a bitset over the vocabulary tells which words have that
   letter there. A word of L letters is looked up by L steps over whole machine words of bits:

       exact     words equal so far             Z' = Z & B[j]
       replaced  one letter replaced so far     S' = S & B[j]  |  Z & ~B[j]
       longer    the word has one letter more   I' = (I | Z) & B[j+1]
       shorter   it has one letter less         D' = D & B[j-1]  |  Z

   (B[j] is the bitset of the letter at hand, at the position shifted by what was inserted or
   left out.) At the end S, I | Z and D, at lengths L, L+1 and L-1, are the words at distance one.
3. Blocks. If two words are at distance one and the shorter has n letters, then either the first
   n//2 letters are equal or the last n - n//2. So a word goes to four blocks: first or last half,
   as the shorter or the longer one. A task lays its blocks side by side in one index and starts
   each look-up with the bits of its own block, so the work follows the size of the blocks and not
   that of the vocabulary. A pair that shares its first half is left out of the block of the last
   half. Many look-ups run at once, as rows of one array.
   A block beyond `BLOCK_LETTERS` is dealt into parts; every part is looked up in every other, in
   tasks of their own. No pairs are written: a word's rows are its count of near words and the best.
4. Within a block words stand by (count, word), so the best near word is the lowest bit.
5. Roots follow forms by doubling. A form has at least twice the count, so a chain has fewer
   than 64 links.

Defined results: null texts have no words; a null id counts as an empty one; equal rows are
counted each; runs of any length are taken whole; without words there are no rows; other
columns are ignored. Letters are [A-Za-z] and U+00C0 to U+00FF, one byte each in the index.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelake.session import materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTER = re.compile("[A-Za-zÀ-ÿ]")
SHORTEST = 5
LEAST = 3
DROP_OF = 97  # a run whose hash this divides loses a letter

PIECE_CHARS = 1 << 20
HELD_WORDS = 200_000
BLOCK_LETTERS = 1 << 20
CELLS = 1 << 18  # machine words of one array of look-ups

FIRST, LAST = 0, 1


def _pieces(text: str):
    """The text in parts that do not cut a run, unless a run is longer than the text's rest."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE_CHARS)
        while end < len(text) and LETTER.match(text, end):
            end += 1
        yield text[at:end]
        at = end


def run_counts(text: str, head: int) -> Counter:
    """Words of one text; `head` is the crc32 of what stands before a run."""
    runs: Counter = Counter()
    for piece in _pieces(text):
        # Bytes are put in lower case by A-Z alone.
        runs.update(RUN.findall(piece.encode().lower().decode()))
    out: Counter = Counter()
    for run, n in runs.items():
        if len(run) < SHORTEST:
            continue
        h = zlib.crc32(run.encode(), head)
        if h % DROP_OF == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < SHORTEST:
                continue
        out[run] += n
    return out


def _count(batches):
    held: Counter = Counter()

    def flush():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            if not text.is_valid:
                continue
            doc = doc.as_py()
            head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            held.update(run_counts(text.as_py(), head))
            if len(held) >= HELD_WORDS:
                yield flush()
    if held:
        yield flush()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(word, n) of all words that occur `least` times or more."""
    parts = docs.select(id_col, text_col).mapInArrow(_count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def blocks_of(words: DataFrame, letters: int = BLOCK_LETTERS) -> DataFrame:
    """(block, word, n, of, half, indexed, asked): the words of every block, large blocks in parts.

    `of` is the length of the shorter word of the pairs that the block is for.
    """
    size = F.length("word")
    entries = []
    for half in (FIRST, LAST):
        for of in (size, size - 1):
            cut = F.floor(of / 2).cast("int")
            text = F.substring(F.col("word"), F.lit(1), cut) if half == FIRST else F.substring(
                F.col("word"), size - (of - cut) + 1, of - cut)
            entries.append(F.struct(F.lit(half).alias("half"), of.alias("of"), text.alias("part")))
    rows = words.select("word", "n", F.explode(F.array(*entries)).alias("e")).select("word", "n", "e.half", "e.of", "e.part")
    rows = rows.withColumn("block", F.xxhash64("half", "of", "part")).drop("part")
    large = rows.groupBy("block").agg(F.sum(F.length("word")).alias("letters")).filter(F.col("letters") > letters)
    large = large.select("block", F.ceil(F.col("letters") / letters).alias("parts"))
    rows = rows.join(large, "block", "left")
    mine = F.pmod(F.xxhash64("word"), F.col("parts"))
    # Part i is the index and part q the look-ups of block (i, q).
    deal = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    split = rows.filter(F.col("parts").isNotNull()).withColumn("mine", mine).withColumn("other", deal)
    keep = ["word", "n", "of", "half"]
    whole = rows.filter(F.col("parts").isNull()).select("block", *keep, F.lit(True).alias("indexed"), F.lit(True).alias("asked"))
    index = split.select(F.xxhash64("block", "mine", "other").alias("block"), *keep,
                         F.lit(True).alias("indexed"), (F.col("mine") == F.col("other")).alias("asked"))
    ask = split.filter(F.col("mine") != F.col("other")).select(
        F.xxhash64("block", "other", "mine").alias("block"), *keep, F.lit(False).alias("indexed"), F.lit(True).alias("asked"))
    return whole.unionByName(index).unionByName(ask)


def _bitset(flags: np.ndarray, width: int) -> np.ndarray:
    """Rows of flags as rows of `width` machine words, the lowest bit first."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    out = np.zeros(flags.shape[:-1] + (width * 8,), np.uint8)
    out[..., : packed.shape[-1]] = packed
    return out.view(np.uint64)


class PositionIndex:
    """Bitsets over words, one a position and letter, and one a length."""

    def __init__(self, letters: np.ndarray, sizes: np.ndarray):
        n, longest = letters.shape
        self.width = -(-max(n, 1) // 64) + 1  # the last one stays empty
        self.at: list[np.ndarray] = []  # by position: bitset of every letter that stands there
        self.letters: list[np.ndarray] = []  # by position: the letters of those bitsets; bitset 0 is empty
        for j in range(longest):
            here = np.unique(letters[:, j])
            here = here[here > 0]
            table = np.zeros((len(here) + 1, self.width), np.uint64)
            table[1:] = _bitset(letters[:, j][None, :] == here[:, None], self.width)
            self.at.append(table)
            self.letters.append(here)
        self.sizes = {int(s): _bitset((sizes == s)[None, :], self.width)[0] for s in np.unique(sizes)}
        self.empty = np.zeros(self.width, np.uint64)

    def bits(self, position: int, letters: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """[look-up, cell]: the bitset of each look-up's letter at the position, at its cells."""
        if not 0 <= position < len(self.at):
            return np.zeros(cells.shape, np.uint64)
        here = self.letters[position]
        if not len(here):
            return np.zeros(cells.shape, np.uint64)
        row = np.minimum(np.searchsorted(here, letters), len(here) - 1)
        row = np.where(here[row] == letters, row + 1, 0)
        return self.at[position][row[:, None], cells]

    def near(self, words: np.ndarray, cells: np.ndarray, start: np.ndarray, of: int, half: int) -> np.ndarray:
        """Bits at distance one of `words` (all of one length, a row each), among `start`, by the block's rule."""
        size = words.shape[1]
        exact, zero = start, np.zeros_like(start)
        replaced = longer = shorter = zero
        shared = start if of // 2 == 0 else None
        for j in range(size):
            letter = words[:, j]
            here = self.bits(j, letter, cells)
            if size == of:
                after = self.bits(j + 1, letter, cells)
                replaced, longer = (replaced & here) | (exact & ~here), (longer | exact) & after
            else:
                before = self.bits(j - 1, letter, cells)
                shorter = (shorter & before) | exact
            exact = exact & here
            if j + 1 == of // 2:
                shared = exact
        sized = lambda s: self.sizes.get(s, self.empty)[cells]
        if size == of:
            found = (replaced & sized(of)) | ((longer | exact) & sized(of + 1))
        else:
            found = shorter & sized(of)
        return found & (shared if half == FIRST else ~shared)


def _mask(first: np.ndarray, last: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Bits [first, last) of each row, as they lie in its cells."""
    low = cells.astype(np.int64) * 64
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    start = np.clip(first[:, None] - low, 0, 64)
    stop = np.clip(last[:, None] - low, 0, 64)
    up = lambda k: np.where(k >= 64, np.uint64(0), full << np.minimum(k, 63).astype(np.uint64))
    return up(start) & ~up(stop)


def near_in_blocks(block, word, n, of, half, indexed, asked):
    """(row, near words, row of the best) for arrays that are sorted by (block, n descending, word).

    `word` has Latin-1 bytes. Words of about the same length share an index, so that a long one
    does not widen it for all; words alone in their block are left out.
    """
    block, n, of, half, indexed, asked = map(np.asarray, (block, n, of, half, indexed, asked))
    same = block[1:] == block[:-1]
    paired = np.concatenate((same, [False])) | np.concatenate(([False], same))
    scale = np.log2(of).astype(np.int64)
    for kind in np.unique(scale[paired]):
        rows = np.flatnonzero(paired & (scale == kind))
        for row, near, best in _near_in_index(
                block[rows], [word[r] for r in rows], of[rows], half[rows], indexed[rows], asked[rows]):
            yield rows[row], near, rows[best]


def _near_in_index(block, word, of, half, indexed, asked):
    rows = len(word)
    sizes = np.fromiter(map(len, word), np.int64, rows)
    letters = np.zeros((rows, int(sizes.max())), np.uint8)
    flat = np.frombuffer(b"".join(word), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    letters[np.repeat(np.arange(rows), sizes), np.arange(len(flat)) - np.repeat(begin, sizes)] = flat
    position = np.flatnonzero(indexed)  # words of the index, in order
    if not len(position):
        return
    index = PositionIndex(letters[position], sizes[position])
    first = np.searchsorted(block[position], block, side="left")
    last = np.searchsorted(block[position], block, side="right")
    low = first >> 6
    width = np.where(last > first, ((last - 1) >> 6) - low + 1, 0)
    width = np.where(width > 0, 1 << np.ceil(np.log2(np.maximum(width, 1))).astype(np.int64), 0)
    # A word alone in its block has nothing near.
    ask = np.flatnonzero(asked & (last - first > indexed))
    group = np.stack([sizes[ask], of[ask], half[ask], width[ask]])
    kinds, member = np.unique(group, axis=1, return_inverse=True)
    order = np.argsort(member.ravel(), kind="stable")
    bounds = np.searchsorted(member.ravel()[order], np.arange(kinds.shape[1] + 1))
    for k in range(kinds.shape[1]):
        size, shorter, side, cell = (int(x) for x in kinds[:, k])
        members = ask[order[bounds[k] : bounds[k + 1]]]
        step = max(1, CELLS // cell)
        for at in range(0, len(members), step):
            some = members[at : at + step]
            cells = np.minimum(low[some][:, None] + np.arange(cell), index.width - 1)
            start = _mask(first[some], last[some], low[some][:, None] + np.arange(cell))
            found = index.near(letters[some, :size], cells, start, shorter, side)
            hit = np.flatnonzero(found.any(axis=1))
            if not len(hit):
                continue
            found = found[hit]
            where = (found != 0).argmax(axis=1)
            cell_bits = found[np.arange(len(hit)), where]
            lowest = np.bitwise_count((cell_bits & (~cell_bits + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            best = position[(low[some[hit]] + where) * 64 + lowest]
            yield some[hit], np.bitwise_count(found).sum(axis=1).astype(np.int64), best


def _look_up(letters: int):
    schema = ["word", "near", "best_n", "best"]

    def answer(table: pa.Table):
        col = {name: table.column(name).to_numpy() for name in ("block", "n", "of", "half", "indexed", "asked")}
        word = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        texts = table.column("word").combine_chunks()
        for row, near, best in near_in_blocks(word=word, **col):
            yield pa.RecordBatch.from_arrays(
                [texts.take(pa.array(row)), pa.array(near), pa.array(col["n"][best]), texts.take(pa.array(best))], schema)

    def look_up(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(batch.schema.get_field_index("word")).nbytes
            if size >= letters:
                table = pa.Table.from_batches(held)
                blocks = table.column("block").to_numpy()
                # The last block may go on in the next batch.
                cut = int(np.searchsorted(blocks, blocks[-1], side="left"))
                if cut:
                    yield from answer(table.slice(0, cut))
                    rest = table.slice(cut)
                    held, size = rest.to_batches(), rest.column("word").nbytes
        if held:
            yield from answer(pa.Table.from_batches(held))

    return look_up


def near_words(words: DataFrame, letters: int = BLOCK_LETTERS) -> DataFrame:
    """(word, n_near, best, best_n) of all words of (word, n) that have a word at distance one.

    `best` is the near word of largest n, ties go to the smallest in code-point order.
    """
    rows = blocks_of(words, letters).repartition("block").sortWithinPartitions("block", F.col("n").desc(), "word")
    found = rows.mapInArrow(_look_up(letters), "word string, near long, best_n long, best string")
    best = F.struct((-F.col("best_n")).alias("m"), F.col("best"))
    out = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(best).alias("b"))
    return out.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def follow(forms: DataFrame, links: int = 63) -> DataFrame:
    """`forms` (word, form) with `root`: the last word that forms lead to, the word itself without one."""
    roots = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    reach = 1
    while reach < links:
        ahead = roots.filter(F.col("word") != F.col("root")).select(
            F.col("word").alias("root"), F.col("root").alias("further"))
        step = roots.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = materialize(step, "roots")
        roots, reach = step.drop("moved"), reach * 2
        if step.filter("moved").isEmpty():
            break
    return forms.join(roots, "word")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                   ratio: int = 2, letters: int = BLOCK_LETTERS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the whole vocabulary.

    A word's form is its near word of largest count, if that is at least `ratio` times its own.
    """
    words = materialize(vocabulary(docs, id_col, text_col, least), "vocabulary")
    found = words.join(near_words(words, letters), "word", "left")
    better = F.col("best_n") >= ratio * F.col("n")
    found = materialize(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n")), "forms")
    return follow(found)
