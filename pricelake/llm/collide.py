"""Approximate nearest neighbours by collision counting over sorted projections.

Vectors lie in blocks of at most `BLOCK` rows, dealt evenly. A block's index is one sorted array
a projection: the values of its vectors on a Gaussian direction. A query opens a window around its
own value in every array; a vector collides once for each window that holds it. With radius R the
half width is R * WIDTH / 2, so widening the windows stands for hashing anew at a larger radius
(virtual rehashing). A window is found by binary search, as a range of ranks; whether it holds a vector
is told by the vector's rank in that array. Vectors that collide at least `threshold` times are verified
by their exact inner product.

A vector at distance R collides with probability 2 Phi(WIDTH / 2) - 1, a nearer one more often; the
threshold is the count that it reaches with probability 1 - MISS. A query is done in a block when the
`k`-th verified vector lies within R, so every better one was verified with that probability. There is
no limit on candidates.

Largest inner product becomes smallest distance by one more component, sqrt(M^2 - |x|^2) with the
block's largest norm M (0 for the query, which is scaled to M): |q' - x'|^2 = 2 M^2 - 2 M q.x / |q|.

Each query first searches the block it is dealt to, where the radius grows. The k-th product
found bounds what other blocks can add, so there the windows open once, at that bound. Blocks and
queries are joined by streaming the queries past a block's index: each task holds one block and one
Arrow batch of queries. A block answers with at most k rows a query, ranked over all blocks then.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part; nor
do those whose length is not the most frequent one (ties: the longer). Rows with equal ids are vectors
of their own and only a query's own row is left out. Fewer candidates than k are all returned: a radius
beyond any distance verifies the rest. Equal products go to the smaller id, a null id comes last.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricelake.operators.chunks import top_per_key
from pricelake.session import materialize

BLOCK = 8192
APART = 1024.0  # further than values on a direction can be
PROJECTIONS = 96
WIDTH = 2.0
MISS = 0.05
GROWTH = 1.15
START = 0.5  # first radius in units of M
SEED = 0x5EED

NO_ID = (1 << 63) - 1


def threshold(projections: int = PROJECTIONS, miss: float = MISS) -> int:
    """Largest count that a vector at the radius reaches with probability 1 - miss."""
    p = math.erf(WIDTH / 2 / math.sqrt(2))
    tail = 0.0
    for hits in range(projections + 1):
        tail += math.comb(projections, hits) * p**hits * (1 - p) ** (projections - hits)
        if tail > miss:
            return hits
    return projections


class SortedProjections:
    """The sorted arrays of one block, and its vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.rows, self.vectors = ids, rows, vectors
        n, dim = vectors.shape
        squares = np.einsum("ij,ij->i", vectors, vectors)
        self.norm = math.sqrt(squares.max())
        # Unit scale, so that no square overflows in the distances.
        unit = vectors / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", unit, unit)))
        self.directions = np.random.default_rng(SEED).standard_normal((dim + 1, projections))
        values = unit @ self.directions[:dim] + rest[:, None] * self.directions[dim]
        order = np.argsort(values, axis=0, kind="stable")
        # All arrays in one, so that one search finds the ends of all windows.
        self.base = np.arange(projections) * APART
        self.values = (np.take_along_axis(values, order, axis=0) + self.base).T.ravel()
        self.first = np.arange(projections) * n
        self.ranks = np.empty((projections, n), np.uint16 if n <= 1 << 16 else np.uint32)
        np.put_along_axis(self.ranks, order.T, np.arange(n, dtype=self.ranks.dtype)[None, :], axis=1)
        self.need = threshold(projections)

    def collisions(self, center: np.ndarray, half: float) -> np.ndarray:
        """In how many windows each vector lies."""
        low = np.searchsorted(self.values, self.base + center - half) - self.first
        size = np.searchsorted(self.values, self.base + center + half, side="right") - self.first - low
        kind = self.ranks.dtype
        # Ranks below the window wrap around to large numbers. A window of all ranks may not fit the type.
        some = np.flatnonzero(size > 0)
        inside = (self.ranks if len(some) == len(size) else self.ranks[some]) - low[some].astype(kind)[:, None]
        inside = inside <= (size[some] - 1).astype(kind)[:, None]
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8 if len(some) < 256 else np.uint32)

    def search(self, query: np.ndarray, own: int, k: int, bound: float | None):
        """(ids, products) of the best k vectors of the block but row `own`; `bound`: products below do not matter."""
        n = len(self.ids)
        size = math.sqrt(query @ query)
        center = (query / size) @ self.directions[: len(query)]
        reach = lambda product: math.sqrt(max(0.0, 2.0 - 2.0 * product / (self.norm * size)))
        last = math.inf if bound is None else reach(bound)
        radius = START if bound is None else min(last, 2.0)
        seen = np.zeros(n, bool)
        found, products = np.zeros(0, np.int64), np.zeros(0)
        while True:
            if radius >= 2.0:
                fresh = np.flatnonzero(~seen)  # nothing is farther
            else:
                fresh = np.flatnonzero((self.collisions(center, radius * WIDTH / 2) >= self.need) & ~seen)
            seen[fresh] = True
            fresh = fresh[self.rows[fresh] != own]
            # Summed row by row, so that equal vectors have equal products.
            product = (self.vectors[fresh] * query).sum(axis=1)
            if bound is not None:
                fresh, product = fresh[product >= bound], product[product >= bound]
            found, products = np.concatenate((found, fresh)), np.concatenate((products, product))
            best = np.lexsort((self.ids[found], -products))[:k]
            found, products = found[best], products[best]
            if radius >= min(last, 2.0) or len(found) == k and reach(products[-1]) <= radius:
                return self.ids[found], products
            radius *= GROWTH


def _matrix(values: pa.Array) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def _search(k: int, projections: int):
    """Rows of a block come first (`asks` false), then the queries that it answers."""
    names = ["asker", "query", "id", "score"]

    def search(batches):
        block, held, index = None, [], None
        for batch in batches:
            part = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(part)]):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if part[a] != block:
                    block, held, index = part[a], [], None
                if not asks[a]:
                    held.append(some)
                    continue
                if not held:
                    continue  # a query whose block has no rows
                if index is None:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    index = SortedProjections(
                        rows.column("id").to_numpy(), rows.column("row").to_numpy(),
                        _matrix(rows.column("vector").combine_chunks()), projections)
                out = [[], [], [], []]
                vectors = _matrix(some.column(4))
                for query, own, vector, bound in zip(
                        some.column(2).to_pylist(), some.column(3).to_pylist(), vectors, some.column(5).to_pylist()):
                    ids, products = index.search(vector, own, k, bound)
                    out[0].append(np.full(len(ids), own))
                    out[1].append(np.full(len(ids), query))
                    out[2].append(ids)
                    out[3].append(products)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), t) for c, t in zip(out, (pa.int64(),) * 3 + (pa.float64(),))], names)

    return search


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, asks: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding",
            block_rows: int = BLOCK, projections: int = PROJECTIONS) -> DataFrame:
    """(query_id, rank, id, score): the k vectors of largest inner product found for each row where `asks` holds."""
    kept = vectors.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(asks, F.lit(False)).alias("query"))
    kept = kept.filter(_usable(F.col("vector"))).withColumn("row", F.monotonically_increasing_id())
    kept = materialize(kept, "vectors")
    sizes = kept.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.orderBy(F.col("n").desc(), F.col("size").desc()).first()
    length, count = (usual["size"], usual["n"]) if usual else (0, 0)
    blocks = max(1, -(-count // block_rows))
    kept = kept.filter(F.size("vector") == length).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    def answers(queries: DataFrame) -> DataFrame:
        index = kept.select("block", F.lit(False).alias("asks"), "id", "row", "vector", F.lit(None).cast("double").alias("bound"))
        lined = index.unionByName(queries.select("block", F.lit(True).alias("asks"), "id", "row", "vector", "bound"))
        lined = lined.repartitionByRange(blocks, "block").sortWithinPartitions("block", "asks")
        return lined.mapInArrow(_search(k, projections), "asker long, query long, id long, score double")

    queries = kept.filter("query")
    home = materialize(answers(queries.withColumn("bound", F.lit(None).cast("double"))), "home")
    # Fewer than k found at home bound nothing.
    bounds = home.groupBy("asker").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    away = queries.join(bounds, queries["row"] == bounds["asker"], "left").withColumn("home", F.col("block"))
    away = away.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = home.unionByName(answers(away.filter(F.col("block") != F.col("home"))))
    ranked = top_per_key(found, ["asker"], [F.col("score").desc(), F.col("id")], k, rank="rank")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return ranked.select(known("query").alias("query_id"), "rank", known("id").alias(id_col), "score")
