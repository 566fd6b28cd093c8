import random
import re
import zlib
from collections import Counter

import pytest

from pricelake.llm import spelling


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(docs):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}


def brute(docs):
    words = brute_words(docs)
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def run(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = spelling.group_variants(df, **kw)
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in out.collect())


def corpus(seed, letters, longest, words, texts):
    rng = random.Random(seed)
    known = ["".join(rng.choice(letters) for _ in range(rng.randint(4, longest))) for _ in range(words)]
    out = []
    for i in range(texts):
        said = []
        for _ in range(rng.randint(0, 60)):
            w = known[int(rng.random() ** 2 * len(known))]
            if rng.random() < 0.3:
                k = rng.randrange(len(w) + 1)
                w = w[:k] + rng.choice(["", rng.choice(letters)]) + w[k + rng.choice([0, 1]):]
            said.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", ", ", "7"]).join(said)))
    return out + [(None, out[0][1]), (1, out[1][1]), (1, out[1][1]), (texts, None), (texts + 1, "")]


@pytest.mark.parametrize("seed,letters,longest,kw", [
    (1, "ab", 7, {}), (2, "abcdefgé", 9, {}), (3, "aÉéÿ", 12, {"letters": 64}), (4, "abc", 6, {"letters": 200}),
    (5, "a", 90, {})])
def test_like_brute_force(spark, seed, letters, longest, kw):
    docs = corpus(seed, letters, longest, 60, 80)
    got = run(spark, docs, **kw)
    assert got == brute(docs)
    assert any(r[3] for r in got)


def test_empty_and_long(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "a b c")]) == []
    long = "x" * 300_000
    docs = [(1, f"{long} {long} {long}"), (2, " ".join([long[:-1] + "y"] * 9)), (3, "short words short words short")]
    assert run(spark, docs) == brute(docs)


def test_pieces_keep_runs_whole(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE_CHARS", 3)
    text = "abcdef, gh ijklmno;pqrstu abcdef"
    assert "".join(spelling._pieces(text)) == text
    want = Counter({w: text.count(w) for w in ("abcdef", "ijklmno", "pqrstu")})
    assert sum(spelling.run_counts(text, zlib.crc32(b"1:")).values()) == sum(want.values())


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "apple apple apple", 5, "z")], "doc_id long, text string, n long, word string")
    assert [(r.word, r.n) for r in spelling.group_variants(df).collect()] == [("apple", 3)]


def test_registered_query_against_brute_force(spark, sf):
    from pricelake.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = brute_words(docs)
    rows = QUERIES["op11_spelling_variants"](spark, sf).collect()
    assert {(r.word, r.n) for r in rows} == set(words.items())
    forms = {}
    for w in words:
        for k in range(len(w) + 1):
            forms.setdefault((len(w), k, w[:k] + w[k + 1:]) if k < len(w) else None, []).append(w)
    near = {w: set() for w in words}
    for key, group in forms.items():
        if key:
            for w in group:
                near[w].update(v for v in group if v != w)
            if key[2] in words:
                for w in group:
                    near[w].add(key[2])
                    near[key[2]].add(w)
    assert {r.word: r.n_near for r in rows} == {w: len(v) for w, v in near.items()}
