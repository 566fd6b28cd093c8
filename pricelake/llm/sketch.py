"""Document fingerprints by a threshold-scaled sketch, with DataFrame functions only.

A text's sketch holds every distinct hash of its five-word shingles that lies in the
lowest `1/scale` of the hash range. The cut is the same for all texts, so sketches of
very unequal texts compare without bias (share of one sketch found in the other), and
the sketch of a union is the union of the sketches. A text with fewer than `FLOOR` hashes below
the cut keeps its `FLOOR` smallest ones, or all: so a sketch tells up to where it is complete (the
cut; its largest hash if it has `FLOOR`; anywhere if it has fewer), and two are compared up to where
both are. Texts of fewer than `FLOOR` shingles are compared exactly.

Defined results: words are runs of non-space characters (ASCII spaces); with fewer
than five words the whole sequence is the one shingle; null and empty texts, and texts
of spaces, have the empty sketch; two empty sketches are alike (1), an empty and a
non-empty one are not (0). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricelake.llm.mixing import SPACE, SPACES

WIDTH = 5
SCALE = 8
FLOOR = 32
CHUNK = 4096


def add_sketch(df: DataFrame, text_col: str, out: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """`df` with column `out`: sorted array of the retained hashes of `text_col`."""
    words, hashes, kept = f"{out}_w", f"{out}_h", f"{out}_k"
    top = -(1 << 63) + (1 << 64) // scale - 1
    trimmed = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACES))
    # Each word is hashed once; a shingle's hash is taken over its words' hashes.
    df = df.withColumn(words, F.transform(F.split(trimmed, SPACE), lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(0), F.size(words) - width)
    shingle = lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)])
    df = df.withColumn(
        hashes,
        F.when(trimmed == "", F.array().cast("array<bigint>"))
        .when(F.size(words) < width, F.array(F.xxhash64(F.col(words))))
        .otherwise(F.transform(starts, shingle)))
    df = df.withColumn(kept, F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h <= top))))
    lowest = F.slice(F.sort_array(F.array_distinct(hashes)), 1, FLOOR)
    return df.withColumn(out, F.when(F.size(kept) >= FLOOR, F.col(kept)).otherwise(lowest)).drop(words, hashes, kept)


def _upto(sketch: Column, scale: int) -> Column:
    """The hash up to which a sketch is complete."""
    top = -(1 << 63) + (1 << 64) // scale - 1
    return F.when(F.size(sketch) < FLOOR, F.lit((1 << 63) - 1)).when(
        F.size(sketch) == FLOOR, F.greatest(F.lit(top), F.array_max(sketch))).otherwise(F.lit(top))


def _comparable(a: Column, b: Column, scale: int) -> tuple[Column, Column]:
    both = F.least(_upto(a, scale), _upto(b, scale))
    return F.filter(a, lambda h: h <= both), F.filter(b, lambda h: h <= both)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of the union of two texts' shingles."""
    top = -(1 << 63) + (1 << 64) // scale - 1
    both = F.sort_array(F.array_union(*_comparable(a, b, scale)))
    below = F.filter(both, lambda h: h <= top)
    return F.when(F.size(below) >= FLOOR, below).otherwise(F.slice(both, 1, FLOOR))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    a, b = _comparable(a, b, scale)
    common = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - common
    return F.when(whole == 0, F.lit(1.0)).otherwise(common / whole)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    a, b = _comparable(a, b, scale)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def with_next(df: DataFrame, key: str, carried: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """Each row with `carried` columns of the next row by descending `key`; the last takes the first's.

    Rows are cut into runs of about `chunk` keys, each ordered in one task, and the last
    row of a run takes from the first row of the next run. Only one row per run goes
    through a window over everything. Ties are ordered by content, null keys come last.
    """
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    width = max(chunk, -(-chunk * (int(hi) - int(lo) + 1) // n)) if n else chunk
    # Null keys form a run of their own, below all others.
    run = F.when(F.col(key).isNotNull(), F.floor(
        (F.col(key).cast("decimal(38,0)") - F.lit(int(lo or 0))) / F.lit(width)).cast("long"))
    rows = df.withColumn("sk_run", F.coalesce(run, F.lit(-1)))
    within = W.partitionBy("sk_run").orderBy(
        F.col(key).desc(), *[F.col(c) for c, t in df.dtypes if c in carried and t == "string"])
    # The flag of the first row is a lag, not a rank, so that both uses below share one exchange.
    rows = rows.withColumns({f"sk_{to}": F.lead(c).over(within) for c, to in carried.items()} | {
        "sk_last": F.lead(F.lit(1)).over(within).isNull(), "sk_first": F.lag(F.lit(1)).over(within).isNull()})
    heads = rows.filter("sk_first").select(
        F.col("sk_run").alias("sk_to"), *[F.col(c).alias(f"sk_head_{to}") for c, to in carried.items()])
    every = W.orderBy(F.col("sk_run").desc())
    links = df.select(F.coalesce(run, F.lit(-1)).alias("sk_run")).distinct().select(
        F.col("sk_run").alias("sk_from"),
        F.coalesce(F.lead("sk_run").over(every), F.max("sk_run").over(W.partitionBy())).alias("sk_to"))
    heads = links.join(heads, "sk_to").drop("sk_to")
    joined = rows.join(heads, (F.col("sk_run") == F.col("sk_from")) & F.col("sk_last"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[
        F.when(F.col("sk_last"), F.col(f"sk_head_{to}")).otherwise(F.col(f"sk_{to}")).alias(to)
        for to in carried.values()])
