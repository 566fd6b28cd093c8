import zlib

import numpy as np
import pyarrow as pa

from pricelake.llm import quality, text as tx


def test_isotonic_pools():
    curve = quality.isotonic(np.array([2, 0, 2, 2, 4]), np.array([0, 0, 2, 0, 4]))
    assert (np.diff(curve) >= 0).all()
    assert abs(curve[2] - curve[3]) < 1e-12 and curve[0] < 0.2 and curve[4] == 0.9


def test_statistics_are_finite_and_local():
    texts = ["", None, "Aa aa. %%%", "x" * 5000, "é\n\n| |", "  "]
    block = next(tx.blocks([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])], "text"))
    every = quality.statistics(block)
    assert np.isfinite(every).all() and (every[:2] == 0).all()
    for i, t in enumerate(texts):
        one = next(tx.blocks([pa.RecordBatch.from_arrays([pa.array([t], pa.string())], ["text"])], "text"))
        assert np.allclose(quality.statistics(one)[0], every[i])


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, stats int")
    described = quality.describe(empty)
    assert described.columns == ["doc_id", "stats"] and described.collect() == []
    docs = quality.describe(spark.createDataFrame([(1, "a"), (None, None), (1, "a")], "doc_id long, text string"))
    from pyspark.sql import functions as F

    for label, want in ((None, 0.5), (1, 1.0), (0, 0.0)):
        rows = docs.select("stats", F.lit(label).cast("int").alias("label"), F.lit(False).alias("calibrate"))
        assert {r.score for r in quality.apply(docs, quality.fit(rows)).collect()} == {want}


def test_held_out(spark):
    from pricelake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality_kernel"](spark, sf).collect()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9


def plain_isotonic(y, w):
    """Best non-decreasing fit by the max-min formula."""
    n = len(y)
    mean = lambda a, b: np.dot(y[a:b + 1], w[a:b + 1]) / w[a:b + 1].sum()
    return np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_fit_equals_plain_numpy(spark, sf):
    """Standardisation, features, ridge solution and calibration in one process over all labelled rows."""
    from pyspark.sql import functions as F

    from pricelake.llm.queries import fold

    docs = quality.describe(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).repartition(5)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    known = docs.filter(fold(5) != 0).join(labels, "doc_id").withColumn("calibrate", fold(5) == 1)
    got = {r.doc_id: r.score for r in quality.apply(docs, quality.fit(known)).collect()}

    rows = known.collect()
    x = np.array([r.stats for r in rows], float)
    y = np.array([r.label for r in rows], float)
    held = np.array([r.calibrate for r in rows])
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    rng = np.random.default_rng(quality.SEED)
    project = rng.normal(size=(quality.SIZE, quality.FEATURES)) / np.sqrt(quality.SIZE)
    phase = rng.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(stats):
        z = np.clip((stats - mean) / scale, -8, 8)
        return np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(z @ project + phase), np.ones((len(z), 1))])

    phi, target = features(x[~held]), y[~held]
    # Ridge as least squares over the data and one more row a weight.
    strength = quality.RIDGE * max(1.0, len(phi)) / quality.FEATURES
    more = np.sqrt(strength) * np.eye(phi.shape[1])
    weights = np.linalg.lstsq(np.vstack([phi, more]), np.concatenate([target, np.zeros(len(more))]), rcond=None)[0]
    place = lambda stats: (np.clip(features(stats) @ weights, quality.LOW, quality.HIGH) - quality.LOW) / (quality.HIGH - quality.LOW)
    bins = np.minimum((place(x[held]) * quality.BINS).astype(int), quality.BINS - 1)
    n = np.bincount(bins, minlength=quality.BINS).astype(float)
    p = np.bincount(bins, weights=y[held], minlength=quality.BINS)
    some = np.flatnonzero(n)
    level = plain_isotonic(p[some] / n[some], n[some])
    # Bins of one level are one pool, with half a row of each label added.
    smooth = np.empty(len(some))
    for value in np.unique(level.round(12)):
        same = level.round(12) == value
        smooth[same] = (p[some][same].sum() + 0.5) / (n[some][same].sum() + 1)
    curve = np.maximum.accumulate(np.interp(np.arange(quality.BINS), some, smooth))
    every = docs.collect()
    at = place(np.array([r.stats for r in every], float))
    want = np.clip(0.998 * np.interp(at, (np.arange(quality.BINS) + 0.5) / quality.BINS, curve) + 0.002 * at, 0, 1)
    assert max(abs(got[r.doc_id] - w) for r, w in zip(every, want)) < 1e-6
