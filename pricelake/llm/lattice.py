"""Text likelihood over all segmentations of words into vocabulary pieces.

The pieces come from an existing vocabulary; nothing is added to it. Its file has no
unigram probabilities (its scores are ranks), so the scores start from the rank and
are re-estimated once or twice from the training words: expected piece counts over
all segmentations of every distinct word. A word's lattice has an edge for each piece at
each place, bytes as a last resort; the forward recursion in log space, one position of
many words at a time, gives the probability of the word over all segmentations. A word
seen in training is one more edge across the whole lattice, with its discounted share of
the training tokens: P(w) = max(c - D, 0) / N + D V / N * P_pieces(w). A text's
probability is the product over its words and one end.

Word counts are a table. The words of the largest counts (at most `HOT_WORDS`, a fixed
size) are sent to the tasks; all other words of a text are looked up by a join, where
none of them can be frequent. The piece scores are as many as the vocabulary has.

Defined results: ASCII letters are lower-cased; words are runs of non-space characters
(ASCII spaces); null and empty texts have one token, the end; repeated rows give repeated
results and count twice in training; null ids stay null; with nothing to learn from,
words are scored by the vocabulary's own scores and the end is certain; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelake.llm import text as tx
from pricelake.llm.manifest import number_rows
from pricelake.session import materialize

DISCOUNT = 0.75
HOT_WORDS = 1 << 18
ROUNDS = 2
RANK_SHIFT = 50.0
BYTE_SCORE = math.log(1e-7)
FLOOR = 1e-9
WORD_BLOCK = 192 << 10
FLUSH = 1_500_000
LN10 = math.log(10)
SPACE = "▁"


class Vocabulary(NamedTuple):
    """Pieces by hash: `first` may begin a word, `inner` stand within; values are piece numbers."""

    size: int
    first: tuple[np.ndarray, np.ndarray]
    inner: tuple[np.ndarray, np.ndarray]
    space: int  # piece number of the space alone, or -1
    longest: int
    scores: np.ndarray  # natural logs


def _table(pieces: list[bytes], numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)
    hashes = tx.span_hash(tx.prefix_sums(tx.BYTE_CODES[data]), ends[:-1], ends[1:])
    order = np.argsort(hashes)
    return hashes[order], np.array(numbers, np.int64)[order]


def vocabulary(model: bytes) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    first, inner, space, rank = ([], []), ([], []), -1, []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        piece = sp.id_to_piece(i)
        body = piece[1:] if piece.startswith(SPACE) else piece
        if SPACE in body:
            continue
        if piece == SPACE:
            space = len(rank)
        else:
            side = first if piece.startswith(SPACE) else inner
            side[0].append(body.encode())
            side[1].append(len(rank))
        rank.append(-sp.get_score(i))
    weight = 1 / (np.maximum(np.array(rank, float), 0) + RANK_SHIFT)
    longest = max((len(p) for p in first[0] + inner[0]), default=0)
    return Vocabulary(len(rank), _table(*first), _table(*inner), space, longest, np.log(weight / weight.sum()))


class Lattice:
    """Edges of many words at once. A word of n bytes has n + 1 nodes; node 0 is after its space."""

    def __init__(self, vocab: Vocabulary, data: np.ndarray, ends: np.ndarray):
        size = np.diff(ends)
        self.words = len(size)
        self.entry = ends[:-1] + np.arange(self.words)  # node 0 of each word
        self.exit = self.entry + size
        word = np.repeat(np.arange(self.words), size)
        left = ends[1:][word] - np.arange(len(data))  # bytes to the word's end
        sums = tx.prefix_sums(tx.BYTE_CODES[data])
        sieve = []
        for hashes, _ in (vocab.first, vocab.inner):
            bits = np.zeros(1 << 20, bool)
            bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
            sieve.append(bits)
        begin = np.zeros(len(data), bool)
        begin[ends[:-1][size > 0]] = True
        # (from, to, piece); a `first` piece starts before node 0 and is marked by from = -1.
        parts = [(np.arange(len(data)) + word, np.arange(len(data)) + word + 1, np.full(len(data), -1))]
        for length in range(1, vocab.longest + 1):
            at = np.flatnonzero(left >= length)
            if not len(at):
                break
            hashes = tx.span_hash(sums, at, at + length)
            place = (hashes >> np.uint64(44)).astype(np.int64)
            for k, (keys, numbers) in enumerate((vocab.first, vocab.inner)):
                maybe = sieve[k][place]
                if k == 0:
                    maybe &= begin[at]
                maybe = np.flatnonzero(maybe)
                if not len(maybe):
                    continue
                found = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
                ok = keys[found] == hashes[maybe]
                start = at[maybe][ok] + word[at[maybe][ok]]
                parts.append((start if k else np.full(len(start), -1), start + length, numbers[found[ok]]))
        source, target, piece = (np.concatenate([p[k] for p in parts]) for k in range(3))
        # Rounds by place in the word, so that a round needs only earlier ones.
        node_word = np.repeat(np.arange(self.words), size + 1)
        step = target - self.entry[node_word[target]]
        order = np.lexsort((target, step))
        self.source, self.target, self.piece = source[order], target[order], piece[order]
        self.rounds = np.concatenate((np.searchsorted(step[order], np.arange(1, (size.max() if self.words else 0) + 2)),))
        self.nodes = len(data) + self.words
        self.vocab = vocab

    def _scores(self, scores: np.ndarray) -> np.ndarray:
        return np.where(self.piece >= 0, scores[self.piece], BYTE_SCORE)

    def forward(self, scores: np.ndarray) -> np.ndarray:
        """Natural log of the probability mass that reaches each node."""
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.entry] = scores[self.vocab.space] if self.vocab.space >= 0 else BYTE_SCORE
        weight = self._scores(scores)
        for a, b in zip(self.rounds[:-1], self.rounds[1:]):
            if a == b:
                continue
            target = self.target[a:b]
            x = weight[a:b] + np.where(self.source[a:b] >= 0, alpha[self.source[a:b]], 0.0)
            heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
            top = np.maximum.reduceat(x, heads)
            total = np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(heads, b - a)))), heads)
            alpha[target[heads]] = top + np.log(total)
        return alpha

    def likelihood(self, scores: np.ndarray) -> np.ndarray:
        return self.forward(scores)[self.exit]

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """Expected count of each piece, each word once."""
        alpha = self.forward(scores)
        beta = np.full(self.nodes, -np.inf)
        beta[self.exit] = 0.0
        weight = self._scores(scores)
        for a, b in zip(self.rounds[:-1][::-1], self.rounds[1:][::-1]):
            source = self.source[a:b]
            keep = source >= 0
            if keep.any():
                # By target, each node's outgoing edges all come in later rounds, so its own value is final here.
                np.logaddexp.at(beta, source[keep], weight[a:b][keep] + beta[self.target[a:b][keep]])
        before = np.where(self.source >= 0, alpha[self.source], 0.0)
        node_word = np.repeat(np.arange(self.words), self.exit - self.entry + 1)
        share = np.exp(before + weight + beta[self.target] - alpha[self.exit][node_word[self.target]])
        real = self.piece >= 0
        out = np.bincount(self.piece[real], weights=share[real], minlength=self.vocab.size)
        if self.vocab.space >= 0:
            start = scores[self.vocab.space] + beta[self.entry] - alpha[self.exit]
            out[self.vocab.space] += np.exp(start[np.isfinite(start)]).sum()
        return out


def _count(batches):
    """Distinct words of a task with their counts: (word, h, c: in training, a: in all)."""
    held, size = [], 0

    def flush():
        h, c, a = (np.concatenate([p[k] for p in held]) for k in range(3))
        words = pa.concat_arrays([p[3] for p in held])
        _, first, group = np.unique(h, return_index=True, return_inverse=True)
        total = lambda v: pa.array(np.bincount(group, weights=v, minlength=len(first)).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [words.take(pa.array(first)), pa.array(h[first].view(np.int64)), total(c), total(a)], ["word", "h", "c", "a"])

    for block in tx.blocks(batches, "text"):
        data = tx.LOWER[block.data]
        starts, stops, bounds = tx.words(data, block.ends)
        if not len(starts):
            continue
        h = tx.span_hash(tx.prefix_sums(tx.BYTE_CODES[data]), starts, stops)
        learn = np.asarray(block.batch.column(0).slice(block.first, block.last - block.first).to_numpy(zero_copy_only=False), bool)
        mine = np.repeat(learn, np.diff(bounds))
        _, first, group = np.unique(h, return_index=True, return_inverse=True)
        held.append((h[first], np.bincount(group, weights=mine), np.bincount(group).astype(float),
                     tx.pieces(data, starts[first], stops[first])))
        size += len(first)
        if size > FLUSH:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _word_blocks(batches):
    return tx.blocks(batches, "word", WORD_BLOCK)


class Model(NamedTuple):
    tokens: int  # N
    kinds: int  # V, the end included
    ends: int  # training texts
    hot: tuple[np.ndarray, np.ndarray, np.ndarray]  # hash (sorted), count, log10 probability

    def base(self, c):
        return np.log10((c + 1) / (self.tokens + self.kinds + 1))

    def end_score(self) -> float:
        return math.log10(max(self.ends - DISCOUNT, DISCOUNT / 2) / self.tokens) if self.ends else 0.0


RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def learn(docs: DataFrame, model: bytes, rounds: int = ROUNDS, hot_words: int = HOT_WORDS) -> tuple[Model, DataFrame]:
    """Learns from the rows of `docs` (learn, text) marked to learn; the table holds all words (h, c, lp)."""
    vocab = vocabulary(model)
    rows = docs.select(F.coalesce("learn", F.lit(False)).alias("learn"), "text")
    counts = rows.mapInArrow(_count, "word binary, h long, c long, a long").groupBy("word", "h").agg(
        F.sum("c").alias("c"), F.sum("a").alias("a"))
    counts = materialize(counts, "words")
    sums = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = rows.filter("learn").count()
    tokens, kinds = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)

    scores = vocab.scores
    for _ in range(rounds if kinds > 1 else 0):

        def expect(batches, scores=scores):
            total = np.zeros(vocab.size)
            for block in _word_blocks(batches):
                total += Lattice(vocab, block.data, block.ends).expected(scores)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

        # At most one row per piece of the vocabulary.
        found = counts.filter("c > 0").select("word").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(
            F.sum("n").alias("n")).toArrow()
        total = np.zeros(vocab.size)
        total[found.column("piece").to_numpy()] = found.column("n").to_numpy()
        share = total / max(total.sum(), 1e-9) + FLOOR
        scores = np.log(share / share.sum())

    def score(batches):
        for block in _word_blocks(batches):
            piece = Lattice(vocab, block.data, block.ends).likelihood(scores)
            c = block.batch.column(2).slice(block.first, block.last - block.first).to_numpy()
            if tokens:
                # Log space: the piece part of a long word would underflow.
                rest = piece + math.log(DISCOUNT * kinds / tokens)
                lp = np.where(c > 0, np.logaddexp(np.log(np.maximum(c - DISCOUNT, 1e-300) / tokens), rest), rest)
            else:
                lp = piece
            span = lambda k: block.batch.column(k).slice(block.first, block.last - block.first)
            yield pa.RecordBatch.from_arrays([span(1), span(2), span(3), pa.array(lp / LN10)], ["h", "c", "a", "lp"])

    table = materialize(counts.select("word", "h", "c", "a").mapInArrow(score, "h long, c long, a long, lp double"), "word-scores")
    # Candidates are the words of the highest powers of two that together reach the budget; of these
    # the first by count, then hash, are sent. Words beyond the budget are joined, whatever their counts.
    power = F.floor(F.log2("a")).cast("int")
    least, held = 1, 0
    for bucket, n in table.groupBy(power.alias("p")).agg(F.count("*").alias("n")).orderBy(F.col("p").desc()).collect():
        held += n
        if held > hot_words:
            least = 1 << bucket
            break
    chosen, rare = table, table.limit(0)
    if held > hot_words:
        lined = number_rows(table.filter(F.col("a") >= least).withColumns({"all": F.lit(""), "less": -F.col("a")}), "all", ["less", "h"])
        lined = materialize(lined, "frequent")
        chosen = lined.filter(F.col("idx") < hot_words)
        rare = table.filter(F.col("a") < least).unionByName(
            lined.filter(F.col("idx") >= hot_words).select("h", "c", "a", "lp"))
    hot = chosen.select("h", "c", "lp").toArrow()
    order = np.argsort(hot.column("h").to_numpy().view(np.uint64))
    hot = (hot.column("h").to_numpy().view(np.uint64)[order], hot.column("c").to_numpy()[order], hot.column("lp").to_numpy()[order])
    return Model(tokens, kinds, ends, hot), rare


def score(docs: DataFrame, model: Model, rare: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score to the other columns of `docs`."""
    keys, counts, logs = model.hot
    base = model.base(counts) if len(keys) else np.zeros(0)
    end_known, end_base, end_lp = int(model.ends > 0), float(model.base(model.ends)), model.end_score()
    others = [c for c in docs.columns if c not in {*RESULTS, text_col}]

    def run(batches):
        for block in tx.blocks(batches, text_col):
            rows = block.last - block.first
            data = tx.LOWER[block.data]
            starts, stops, bounds = tx.words(data, block.ends)
            h = tx.span_hash(tx.prefix_sums(tx.BYTE_CODES[data]), starts, stops)
            row = np.repeat(np.arange(rows), np.diff(bounds))
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            mine, place = row[hit], at[hit]
            total = lambda w: np.bincount(mine, weights=w, minlength=rows)
            row, h = row[~hit], h[~hit]
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))) if len(h) else np.zeros(0, int)
            times = np.diff(np.append(new, len(h)))
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=rows)))).astype(np.int32))
            columns = [c.slice(block.first, rows) for c in block.batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.diff(bounds) + 1), pa.array(total(counts[place] > 0).astype(np.int64) + end_known),
                 pa.array(total(base[place]) + end_base), pa.array(total(logs[place]) + end_lp),
                 pa.ListArray.from_arrays(offsets, pa.array(h[new].view(np.int64))),
                 pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                [*block.batch.schema.names[:-1], "lm_n", "lm_k", "lm_b", "lm_s", "lm_h", "lm_t"])

    rows = docs.select(*[F.col(f"`{c}`") for c in others], text_col)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    parts = materialize(rows.mapInArrow(
        run, schema + "lm_n long, lm_k long, lm_b double, lm_s double, lm_h array<long>, lm_t array<int>"
    ).withColumn("lm_row", F.monotonically_increasing_id()), "text-scores")
    tail = parts.select("lm_row", F.explode(F.arrays_zip("lm_h", "lm_t")).alias("x")).select(
        "lm_row", F.col("x.lm_h").alias("h"), F.col("x.lm_t").alias("t"))
    base_of = F.log10((F.col("c") + 1) / F.lit(float(model.tokens + model.kinds + 1)))
    sums = tail.join(rare.select("h", "c", "lp"), "h").groupBy("lm_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("k"),
        F.sum(F.col("t") * base_of).alias("b"), F.sum(F.col("t") * F.col("lp")).alias("s"))
    out = parts.drop("lm_h", "lm_t").join(sums, "lm_row", "left")
    add = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return out.select(
        *[F.col(f"`{c}`") for c in others], F.col("lm_n").alias("n_tokens"), add("lm_k", "k").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), add("lm_b", "b").alias("base_score"), add("lm_s", "s").alias("score"))
