import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelake.llm import collide

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v])
                                  for i, v in zip(ids, vectors)], SCHEMA)


def exact(ids, vectors, every, k):
    """query -> [(id, score)] by brute force over float32 inputs in double precision."""
    x = np.asarray(vectors, np.float32).astype(np.float64)
    out = {}
    for q, (i, v) in enumerate(zip(ids, x)):
        if i % every:
            continue
        score = (x * v).sum(axis=1)
        order = [j for j in np.lexsort((np.asarray(ids), -score)) if j != q][:k]
        out[i] = [(ids[j], score[j]) for j in order]
    return out


def run(df, every, k, **kw):
    rows = collide.nearest(df, F.col("vec_id") % every == 0, k, **kw).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id if r.query_id is not None else -1, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["sphere", "clusters", "norms"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    n = 1500
    x = rng.standard_normal((n, 24))
    if kind == "clusters":
        x = rng.standard_normal((12, 24))[rng.integers(0, 12, n)] + 0.4 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "norms":
        x *= rng.lognormal(0, 1, (n, 1))
    ids = list(range(n))
    got, want = run(frame(spark, ids, x), 20, 20, block_rows=400), exact(ids, x, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    scores = {q: {i: s for i, s in rows} for q, rows in exact(ids, x, 20, n).items()}
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(math.isclose(s, scores[q][i], rel_tol=1e-12, abs_tol=1e-12) for i, s in rows)


def test_few_candidates_are_all_returned_in_order(spark):
    x = np.random.default_rng(5).standard_normal((12, 8))
    ids = list(range(12))
    got, want = run(frame(spark, ids, x), 4, 20), exact(ids, x, 4, 20)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}


def test_a_third_of_equal_vectors(spark):
    """Ties go to the smaller id, also across blocks."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 16))
    x[::3] = x[0]
    got = run(frame(spark, range(900), x), 30, 20, block_rows=150)
    for q in range(0, 900, 30):
        assert [i for i, _ in got[q]] == [i for i in range(0, 900, 3) if i != q][:20]
        assert len({s for _, s in got[q]}) == 1


def test_odd_vectors(spark):
    good = [[1, 0, 0], [0.9, 0.1, 0], [-1, 0, 0], [0.5, 0.5, 0]]
    odd = [None, [0, 0, 0], [1, None, 0], [float("nan"), 1, 0], [float("inf"), 0, 0], [], [1, 2]]
    df = frame(spark, [0, 1, 2, 3, 10, 20, 30, 40, 50, 60, 70], good + odd)
    got = run(df, 10, 20)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {0: [1, 3, 2]}
    assert run(frame(spark, [], []), 10, 20) == {}
    assert run(frame(spark, [20], [[1.0]]), 20, 20) == {}


def test_equal_and_null_ids_and_extra_columns(spark):
    df = frame(spark, [0, 0, None, 5], [[1, 0], [0.8, 0], [0.8, 0], [0.5, 0.1]])
    df = df.select("*", F.lit(1).alias("rank"), F.lit(2).alias("score"), F.lit(3).alias("block"))
    rows = collide.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted((r["rank"], -1 if r.vec_id is None else r.vec_id) for r in rows) == [
        (1, 0), (1, 0), (2, -1), (2, -1), (3, 5), (3, 5)]


def test_the_threshold_is_the_tail_of_collisions():
    p = math.erf(collide.WIDTH / 2 / math.sqrt(2))
    hits = np.random.default_rng(1).binomial(96, p, 200_000)
    need = collide.threshold(96, 0.05)
    assert (hits >= need).mean() >= 0.95 > (hits >= need + 1).mean() - 0.01


def test_registered_query_recall(spark, sf):
    from pricelake.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], [r.embedding for r in rows]
    got = {}
    for r in QUERIES["op12_collision_search"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(ids, x, 20, 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
