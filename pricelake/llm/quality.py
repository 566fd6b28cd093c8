"""Quality scores from document statistics: random Fourier features, ridge, isotonic calibration.

1. One pass turns every text into a fixed number of statistics (shares of byte classes
   and of each punctuation mark, word and line lengths, repetition). Only the text enters.
2. They are standardised on the learning rows; `FEATURES` cosines of random projections
   approximate a Gaussian kernel.
3. Each task adds up its part of the normal equations; the parts are added by Spark per
   matrix row, in two rounds, and one matrix of fixed size is solved on the driver.
4. Part of the learning rows is kept from the ridge fit; their scores are binned (fixed
   number of bins) and pooled to an isotonic curve, which maps scores to probabilities.

Learning rows beyond `MAX_ROWS` are thinned by a hash of the row (documented bound).

Defined results: a null text counts as empty; empty texts have all statistics 0 and get
the score that follows; rows without label teach nothing; nothing learnt, or labels
of one kind only, gives every text the share of label 1 (0.5 if there is none);
repeated rows give repeated results; an empty table gives an empty result; extra
columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelake.llm import text as tx

FEATURES = 256
MAX_ROWS = 2_000_000
RIDGE = 1e-3
BINS = 512
LOW, HIGH = -0.5, 1.5
SEED = 20
FAN_IN = 32

_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASSES = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "high": range(128, 256),
            "space": (32, 9), "line": (10, 11, 12, 13), "control": [*range(0, 9), *range(14, 32), 127]}
_RAW = len(_CLASSES) + len(_MARKS) + 10
SIZE = _RAW


def statistics(block: tx.Block) -> np.ndarray:
    """Rows x SIZE statistics of a block of texts."""
    data, ends = block.data, block.ends
    rows = len(ends) - 1
    out = np.zeros((rows, SIZE))
    length = np.diff(ends).astype(float)
    code = np.full(256, 255, np.uint8)
    for k, members in enumerate(_CLASSES.values()):
        code[list(members)] = k
    for k, c in enumerate(_MARKS):
        code[c] = len(_CLASSES) + k
    kinds = len(_CLASSES) + len(_MARKS)
    owner = np.repeat(np.arange(rows), np.diff(ends))
    seen = np.bincount(owner * kinds + code[data], minlength=rows * kinds).reshape(rows, kinds) if rows else out[:, :kinds]
    share = lambda a, b: np.divide(a, b, out=np.zeros(rows), where=b > 0)
    out[:, :kinds] = np.sqrt(seen / np.maximum(length, 1)[:, None])

    starts, stops, bounds = tx.words(data, ends)
    count = np.diff(bounds).astype(float)
    of = np.repeat(np.arange(rows), np.diff(bounds))
    size = (stops - starts).astype(float)
    total = lambda w: np.bincount(of, weights=w, minlength=rows)
    mean = share(total(size), count)
    folded = tx.LOWER[data]
    hashes = tx.span_hash(tx.prefix_sums(tx.BYTE_CODES[folded]), starts, stops)
    distinct, most = np.zeros(rows), np.zeros(rows)
    order = np.lexsort((hashes, of))
    if len(order):
        new = np.flatnonzero(np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1]))))
        runs = np.diff(np.append(new, len(order)))
        distinct = np.bincount(of[order][new], minlength=rows).astype(float)
        np.maximum.at(most, of[order][new], runs)
    upper = np.zeros(256)
    upper[65:91] = 1
    letter = upper.copy()
    letter[97:123] = 1
    letter[128:] = 1
    run = lambda table: np.concatenate(([0], np.cumsum(table[data])))
    inside = lambda sums: sums[stops] - sums[starts]
    letters, uppers = inside(run(letter)), inside(run(upper))
    extra = [
        np.log1p(length), np.log1p(count), np.log1p(mean),
        np.log1p(np.sqrt(np.maximum(share(total(size**2), count) - mean**2, 0))),
        share(distinct, count), np.sqrt(share(most, count)),
        share(total(letters == 0), count), share(total((uppers == letters) & (letters > 1)), count),
        share(total(letters < size), count), np.log1p(share(length, 1.0 + seen[:, 5])),
    ]
    for k, column in enumerate(extra):
        out[:, kinds + k] = column
    return out


def describe(docs: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """`docs` without its text, with the statistics as array<float>."""

    def run(batches):
        for block in tx.blocks(batches, text_col):
            rows = block.last - block.first
            values = statistics(block).astype(np.float32).ravel()
            offsets = np.arange(rows + 1, dtype=np.int32) * SIZE
            columns = [c.slice(block.first, rows) for c in block.batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                [*block.batch.schema.names[:-1], out])

    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (text_col, out)], text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}{', ' if schema else ''}{out} array<float>")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten(), np.float64).reshape(batch.num_rows, SIZE)


class Model:
    """Standardisation, projection, ridge weights and the calibration curve."""

    def __init__(self, mean, scale, base):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.weights, self.base = np.zeros(FEATURES + 1), base
        # Unit distances of standardised statistics grow with the root of their number.
        self.project = rng.normal(size=(SIZE, FEATURES)) / np.sqrt(SIZE)
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.curve: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        cosines = np.sqrt(2 / FEATURES) * np.cos(z @ self.project + self.phase)
        return np.hstack([cosines, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(stats), self.base)
        at = (np.clip(self.raw(stats), LOW, HIGH) - LOW) / (HIGH - LOW)
        curve = np.interp(at, (np.arange(BINS) + 0.5) / BINS, self.curve)
        # A slight slope keeps the order within flat parts of the curve.
        return np.clip(0.998 * curve + 0.002 * at, 0, 1)


def isotonic(count: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing means of bins by pooling adjacent violators; empty bins follow their neighbours."""
    pools: list[list[float]] = []
    for k in np.flatnonzero(count):
        pools.append([float(positive[k]), float(count[k]), k, k])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p, n, _, last = pools.pop()
            pools[-1][0] += p
            pools[-1][1] += n
            pools[-1][3] = last
    xs = [x for p in pools for x in (p[2], p[3])]
    ys = [(p[0] + 0.5) / (p[1] + 1) for p in pools for _ in range(2)]
    return np.maximum.accumulate(np.interp(np.arange(len(count)), xs, ys))


def fit(rows: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learns from `rows` (stats, label 0/1, calibrate boolean)."""
    rows = rows.filter("label IS NOT NULL").select("stats", F.col("label").cast("double").alias("label"), "calibrate")
    n, base = rows.agg(F.count("*"), F.avg("label")).first()
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("stats"), F.lit(1 << 20)) < F.lit(int((1 << 20) * max_rows / n)))

    def moments(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "stats")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(SIZE)), pa.array(np.full(SIZE, float(len(x)))), pa.array(x.sum(0)), pa.array((x * x).sum(0))],
                    ["k", "n", "s", "q"])

    sums = rows.mapInArrow(moments, "k long, n double, s double, q double").groupBy("k").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("k").collect()
    if not sums or base in (0.0, 1.0):
        return Model(np.zeros(SIZE), np.ones(SIZE), 0.5 if base is None else base)
    count, s, q = (np.array([r[c] for r in sums]) for c in ("n", "s", "q"))
    mean = s / count
    scale = np.sqrt(np.maximum(q / count - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-6, scale, 1.0), base)

    width = FEATURES + 1

    def equations(batches):
        total = np.zeros((width, width + 1))
        for batch in batches:
            if batch.num_rows:
                phi = model.features(_matrix(batch, "stats"))
                total += phi.T @ np.hstack([phi, batch.column(1).to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array(list(total))], ["k", "part"])

    def add(table: pa.Table) -> pa.Table:
        parts = np.asarray(table.column("part").combine_chunks().flatten()).reshape(-1, width + 1)
        return pa.table({"k": table.column("k").slice(0, 1), "part": [parts.sum(0)]})

    kind = "k long, part array<double>"
    parts = rows.filter("NOT calibrate").select("stats", "label").mapInArrow(equations, kind)
    parts = parts.withColumn("g", F.spark_partition_id() % FAN_IN)
    parts = parts.groupBy("k", "g").applyInArrow(lambda t: add(t.select(["k", "part"])), kind)
    parts = sorted(parts.groupBy("k").applyInArrow(add, kind).collect())
    system = np.array([r.part for r in parts])
    left, right = system[:, :width], system[:, width]
    model.weights = np.linalg.solve(left + np.eye(width) * RIDGE * max(1.0, left[-1, -1]) / FEATURES, right)

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                at = (np.clip(model.raw(_matrix(batch, "stats")), LOW, HIGH) - LOW) / (HIGH - LOW)
                bins = np.minimum((at * BINS).astype(int), BINS - 1)
                label = batch.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(BINS)), pa.array(np.bincount(bins, minlength=BINS)),
                     pa.array(np.bincount(bins, weights=label, minlength=BINS))], ["bin", "n", "p"])

    found = rows.filter("calibrate").select("stats", "label").mapInArrow(binned, "bin long, n long, p double").groupBy("bin").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p")).orderBy("bin").collect()
    if found:
        model.curve = isotonic(np.array([r.n for r in found]), np.array([r.p for r in found]))
    return model


def apply(described: DataFrame, model: Model) -> DataFrame:
    """`described` without its statistics, with `score`."""
    others = [c for c in described.columns if c not in ("stats", "score")]
    rows = described.select(*[F.col(f"`{c}`") for c in others], "stats")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = model.score(_matrix(batch, "stats"))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}{', ' if schema else ''}score double")
