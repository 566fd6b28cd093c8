import math
import zlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path

from pricelake.llm import lattice
from pricelake.llm.tokens import read_model

MODEL = read_model(path("piece_bpe_32k.model"))


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def pieces_of(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [n.encode() for n in names if "▁" not in n[1:]]


def brute(word, pieces, scores):
    """Sum over all segmentations of space + word, by recursion on bytes."""
    text = "▁".encode() + word
    space = len("▁".encode())
    alpha = {0: 1.0}
    for e in range(1, len(text) + 1):
        total = 0.0
        for b, mass in alpha.items():
            k = pieces.get(text[b:e])
            if k is not None:
                total += mass * math.exp(scores[k])
            if b >= space and e == b + 1:
                total += mass * math.exp(lattice.BYTE_SCORE)
        if total:
            alpha[e] = total
    return alpha.get(len(text), 0.0)


def test_forward_and_expected_counts():
    vocab = lattice.vocabulary(MODEL)
    pieces = {p: i for i, p in enumerate(pieces_of(MODEL))}
    assert vocab.size == len(pieces)
    words = ["the", "anonhath", "é", "日本", "x%%%", "qz" * 9, "a"]
    raw = [w.encode() for w in words]
    ends = np.concatenate(([0], np.cumsum([len(w) for w in raw])))
    net = lattice.Lattice(vocab, np.frombuffer(b"".join(raw), np.uint8), ends)
    got = np.exp(net.likelihood(vocab.scores))
    want = [brute(w, pieces, vocab.scores) for w in raw]
    assert np.allclose(got, want, rtol=1e-9)
    # The derivative of the log-likelihood by a score is the expected count.
    expected = net.expected(vocab.scores)
    for piece in (b"th", "▁the".encode(), "▁".encode(), b"a"):
        k, step = pieces[piece], 1e-5
        up, down = vocab.scores.copy(), vocab.scores.copy()
        up[k] += step
        down[k] -= step
        slope = (net.likelihood(up).sum() - net.likelihood(down).sum()) / (2 * step)
        assert abs(slope - expected[k]) < 1e-5


@pytest.mark.parametrize("hot", [0, 3, 1 << 18])
def test_like_plain_counts(spark, hot):
    texts = ["The cat and the dog", "the Dog\tran", None, "", "unseen wörter here the", "and and and", "the cat and the dog"]
    rows = [(i, i not in (4, 6), t) for i, t in enumerate(texts)] + [(None, None, "the end"), (5, True, "and and and")]
    docs = spark.createDataFrame(rows, "doc_id long, learn boolean, text string").selectExpr("*", "1 AS h")
    model, rare = lattice.learn(docs, MODEL, rounds=1, hot_words=hot)
    out = lattice.score(docs, model, rare).collect()
    train = Counter(w for _, learn, t in rows if learn for w in [*split(t), None])
    n, v = sum(train.values()), len(train)
    assert (model.tokens, model.kinds) == (n, v)
    table = {(r.doc_id, r.learn): [] for r in out}
    for r in out:
        table[(r.doc_id, r.learn)].append(r)
    for i, learn, t in rows:
        r = table[(i, learn)][0]
        tokens = [*split(t), None]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in train for w in tokens), n)
        assert abs(r.base_score - base) < 1e-9 and r.score < 0
    assert len(out) == len(rows)
    # The same whichever words are sent along.
    whole, none = lattice.learn(docs, MODEL, rounds=1)
    same = sorted(r.score for r in lattice.score(docs, whole, none).collect())
    assert np.allclose(sorted(r.score for r in out), same)


def test_words_beyond_the_budget_are_joined(spark):
    """The first words by count are sent along, however many share a count."""
    texts = ["a b c d e " * 300, "a b c " * 500, "f g h i j k"]
    docs = spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "doc_id long, learn boolean, text string")
    whole, none = lattice.learn(docs, MODEL, rounds=1)
    assert none.count() == 0 and len(whole.hot[0]) == 11
    want = sorted(r.score for r in lattice.score(docs, whole, none).collect())
    for budget in (1, 2, 4, 7):
        model, rare = lattice.learn(docs, MODEL, rounds=1, hot_words=budget)
        assert len(model.hot[0]) == budget and rare.count() == 11 - budget
        assert sorted(model.hot[1])[0] >= max(r.c for r in rare.collect())
        assert np.allclose(sorted(r.score for r in lattice.score(docs, model, rare).collect()), want)


def test_extra_columns_named_as_results(spark):
    docs = spark.createDataFrame([(1, True, "a word")], "doc_id long, learn boolean, text string")
    docs = docs.selectExpr("*", "1 AS n_tokens", "2 AS n_known", "3 AS train_tokens", "4 AS base_score", "5 AS score", "6 AS lp")
    (r,) = lattice.score(docs, *lattice.learn(docs, MODEL)).collect()
    assert (r.doc_id, r.n_tokens, r.train_tokens, r.lp) == (1, 3, 3, 6)


def test_document_score_sums_its_words(spark):
    """The score of a text is the sum over its words of a lattice that is walked here in plain Python."""
    docs = spark.createDataFrame(
        [(1, True, "the cat the dog"), (2, False, "the bird is the word"), (3, True, "a bird")], "doc_id long, learn boolean, text string")
    model, rare = lattice.learn(docs, MODEL, rounds=0)
    vocab, pieces = lattice.vocabulary(MODEL), {p: i for i, p in enumerate(pieces_of(MODEL))}
    train = Counter(w for t in ("the cat the dog", "a bird") for w in [*t.split(), None])
    n, kinds = sum(train.values()), len(train)

    def word(w):
        rest = math.log(brute(w.encode(), pieces, vocab.scores) * lattice.DISCOUNT * kinds / n)
        return np.logaddexp(math.log((train[w] - lattice.DISCOUNT) / n), rest) if train[w] else rest

    end = math.log((train[None] - lattice.DISCOUNT) / n)
    for r in lattice.score(docs, model, rare).collect():
        text = {1: "the cat the dog", 2: "the bird is the word", 3: "a bird"}[r.doc_id]
        want = (sum(word(w) for w in text.split()) + end) / math.log(10)
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_nothing_learnt(spark):
    docs = spark.createDataFrame([(1, False, "a word"), (2, False, None)], "doc_id long, learn boolean, text string")
    out = sorted(lattice.score(docs, *lattice.learn(docs, MODEL)).collect())
    assert [r.n_tokens for r in out] == [3, 1] and out[0].score < 0 and out[1].score == 0
    empty = docs.limit(0)
    assert lattice.score(empty, *lattice.learn(empty, MODEL)).collect() == []


def test_query(spark, sf):
    from pricelake.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op6_subword_lattice"](spark, sf).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter(w for i, t in docs.items() if not held(i) for w in [*split(t), None])
    n, v = sum(train.values()), len(train)
    assert len(out) == len(docs)
    for r in out:
        tokens = [*split(docs[r.doc_id]), None]
        assert r.held_out == held(r.doc_id) and r.train_tokens == n and r.n_tokens == len(tokens)
        assert r.n_known == sum(w in train for w in tokens)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert r.score < 0
