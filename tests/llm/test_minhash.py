import random

import pytest

from pricelake.llm import minhash


def sets_of(rows):
    out = []
    for _, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        w = [x for x in low.replace("\t", " ").replace("\n", " ").split(" ") if x]
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter) and inter:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), 1 << 63), (1 << 63) if d is None else d)
    fix = lambda v: None if v == 1 << 63 else v
    return sorted(((d, len(sets[i]), fix(best[find(i)])) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.group_near(docs)
    assert out.columns == ["doc_id", "text", "n_shingles", "component_id", "kept"]
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(60)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed,edits", [(1, 2), (2, 4)])
def test_like_brute_force(spark, seed, edits):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [t for _ in range(12) for t in family(rng, words, 12, edits)]
    texts += ["", None, "  \n", "one", "ONE", "one two", "One  two", "one two three four five", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, texts[3]), (None, "alone here"), (5, texts[7]), (5, texts[7])]
    assert run(spark, rows) == brute(rows)


def test_one_of_each_group_is_kept(spark):
    say = "one two three four five six seven eight"
    rows = [(3, say), (2, say.upper()), (2, say), (2, say), (None, say), (7, ""), (7, ""), (None, None), (9, "else")]
    out = minhash.group_near(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS mark")).collect()
    kept = [(r.doc_id, (r.text or "").lower()) for r in out if r.kept]
    assert sorted(kept, key=str) == sorted([(2, say), (7, ""), (7, ""), (None, ""), (9, "else")], key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    from pricelake.llm.queries import QUERIES

    got = [(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op8_near_groups"](spark, sf).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_null_ids_are_told_apart_by_their_texts(spark):
    rows = [(None, f"w{i} a b c d e f g h") for i in range(400)] + [(None, "w1 a b c d e f g h"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS mark", "2 AS doc", "3 AS root")
    out = minhash.group_near(docs).collect()
    assert len(out) == len(rows) and all(r.component_id is None for r in out)
    assert sum(r.kept for r in out if r.text and r.text.startswith("w1 ")) <= 1
    assert {r.n_shingles for r in out} == {0, 5}
