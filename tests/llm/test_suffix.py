import hashlib
import random
import re
from collections import Counter

import pytest

from pricelake.llm import suffix


def brute(rows, length):
    """doc -> (bytes, removed, runs, rest)."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        rest = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, rest))
    return sorted(out, key=str)


def passages(rows, length, words, size):
    """(doc, rest): repeated runs go, to whole characters, if they have more than `words` words or `size` bytes."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        for k in range(len(b)):
            if 0x80 <= b[k] <= 0xBF and gone[k - 1]:
                gone[k] = 1
        for k in reversed(range(len(b) - 1)):
            if 0x80 <= b[k + 1] <= 0xBF and gone[k + 1]:
                gone[k] = 1
        rest, at = b"", 0
        while at < len(b):
            end = at
            while end < len(b) and gone[end] == gone[at]:
                end += 1
            run = b[at:end]
            if not gone[at] or len(re.findall(rb"[^\x20\x09-\x0D]+", run)) <= words and len(run) < size:
                rest += run
            at = end
        out.append((i, rest))
    return out


def run(spark, rows, length, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    out = suffix.strip_repeats(docs, length, **kw)
    assert out.columns == ["doc_id", "text", "kept", "n_bytes", "n_removed", "n_spans"]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()]
    return sorted(got, key=str)


def texts(seed, n, alphabet, longest):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(12)]
    out = []
    for i in range(n):
        t = "".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(alphabet) for _ in range(rng.randint(0, longest)))
        out.append((i, t))
    out += [(n, None), (n + 1, ""), (n + 2, out[0][1]), (n + 2, out[1][1]), (None, out[2][1]), (None, out[2][1])]
    return out


@pytest.mark.parametrize("seed,alphabet,kw", [
    (1, "ab", {}), (2, "abcdef ghé", {}), (3, "aé", {"order_rows": 5}), (4, "abc", {"hot": 2}), (5, "a", {}), (6, "abc", {"often_times": 2})])
def test_like_brute_force(spark, seed, alphabet, kw):
    rows = texts(seed, 40, alphabet, 60)
    assert run(spark, rows, 20, **kw) == brute(rows, 20)


def test_empty_table_and_long_text(spark, monkeypatch):
    assert run(spark, [], 20) == []
    monkeypatch.setattr(suffix, "PIECE_BYTES", 64)
    rows = texts(6, 4, "abcd", 700)
    assert run(spark, rows, 20) == brute(rows, 20)


@pytest.mark.parametrize("seed,gram", [(11, 10), (12, 5), (13, 3)])
def test_whole_characters_and_kept_runs(spark, seed, gram):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in texts(seed, 40, "aé€𐍈 ", 60) if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = lambda b: F.regexp_count(b.cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    out = suffix.strip_repeats(
        docs, 20, gram=gram, whole_characters=True, keep=lambda b, n: (words(b) <= 3) & (n < 60)).collect()
    got = sorted(((r.doc_id, bytes(r.kept)) for r in out), key=str)
    assert got == sorted(passages(rows, 20, 3, 60), key=str)
    assert any(r.n_removed for r in out)


def test_rows_of_one_id_and_many_texts(spark):
    """Only the text tells these rows apart."""
    rows = [(None, f"{i} " + "word " * 12) for i in range(300)] + [(None, f"{i} short") for i in range(300)]
    assert run(spark, rows, 20) == brute(rows, 20)


def test_real_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    from pricelake.llm.queries import QUERIES

    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                 for r in QUERIES["op9_suffix_dedup"](spark, sf).collect())
    want = sorted((i, n, g, s, hashlib.sha256(rest).hexdigest()) for i, n, g, s, rest in brute(rows, 400))
    assert got == want
    assert sum(g for _, _, g, _, _ in got) > 0


def test_scan_needs_little_memory():
    """Eight megabytes of short texts and one long text: a task holds arrays of a small block only."""
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(5)
    texts = [rng.randbytes(1500).hex() for _ in range(2000)] + [rng.randbytes(1 << 20).hex()]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["doc", "mark", "text"])
    tracemalloc.start()
    windows = sum(sum(b.column("n").to_pylist()) for b in suffix._scan(150, 50)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert windows == sum(len(t) - 149 for t in texts)
    assert peak < 150 << 20
