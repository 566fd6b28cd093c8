import random

import public_tokenizers
import pytest
import sentencepiece

from pricelake.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (200, 16), (1000, 1)])
def test_chunks_equal_whole(spark, sf, chunk, overlap):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    odd = ["", None, " ", "   a  b   " * 40, "x" * 900, "日本語のテキスト" * 60 + " a b", "a\n\nb </s> <s>" * 50, "▁a b" * 200, "a b" * 300,
           "é" * 301 + " " + "ü" * 500, "\t \n" * 100, "\x00a b " * 90]
    rows += [(None, t) for t in odd] + [(1, rows[0][1])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens")
    got = sorted(map(tuple, tokens.count_tokens(docs, PATH, chunk=chunk, overlap=overlap).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows), key=str)
    assert got == want


def parts_of(monkeypatch, text, chunk, overlap):
    """(count in chunks, longest part)."""
    encoder = tokens.Encoder(tokens.read_model(PATH), chunk, overlap)
    longest = []
    ends = encoder.ends
    monkeypatch.setattr(encoder, "ends", lambda part: longest.append(len(part)) or ends(part))
    count = encoder.count_long(text.encode())
    assert count == len(encoder.model.encode(text))
    return max(longest)


def test_splices_do_not_fall_back(monkeypatch):
    assert parts_of(monkeypatch, "some words that go on and on, é and ü " * 50, 64, 8) < 150


def test_texts_without_spaces_go_in_parts(monkeypatch):
    rng = random.Random(4)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1_000_000))
    assert parts_of(monkeypatch, letters, 32 << 10, 512) < 40_000
    kana = "".join(rng.choice("日本語のテキスト漢字東京都") for _ in range(100_000))
    assert parts_of(monkeypatch, kana, 32 << 10, 512) < 40_000


def test_the_space_symbol_does_not_switch_chunking_off(monkeypatch):
    assert parts_of(monkeypatch, "some▁words ▁ that▁▁go on " * 4000, 4096, 64) < 5000
    assert parts_of(monkeypatch, "▁" + "a plain text of words " * 4000, 4096, 64) < 5000


def test_empty_table(spark):
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
