import duckdb  # noqa: F401

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

from .test_minhash import brute as near_brute
from .test_suffix import passages


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "mixing"]

    one = stage["language_id"](spark, docs, sf)
    lettered = {i for i, r in rows.items() if r.text and any(c.isalpha() for c in r.text)}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == lettered

    two = stage["near_dedup"](spark, one, sf)
    groups = near_brute([(i, rows[i].text) for i in sorted(lettered)])
    kept = {i for i, _, root in groups if i == root}
    found = {r.doc_id: r for r in two.collect()}
    assert two.columns == docs.columns and set(found) == kept and all(found[i] == rows[i] for i in kept)

    three = stage["suffix_dedup"](spark, two, sf)
    want = {i: rest.decode() for i, rest in passages([(i, rows[i].text) for i in kept], 150, 50, 400)}
    assert sum(want[i] != rows[i].text for i in kept) > 0
    cut = {r.doc_id: r for r in three.collect()}
    assert three.columns == docs.columns and {i: r.text for i, r in cut.items()} == want
    assert all(r.n_chars == len(r.text) for r in cut.values())

    four = stage["decontamination"](spark, three, sf)
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, t in want.items() if any(x in " ".join(t.split()) for x in items)}
    clean = {r.doc_id for r in four.collect()}
    assert four.columns == docs.columns and clean <= set(want) - leaks and len(clean) >= len(set(want) - leaks) - 1

    five = stage["mixing"](spark, four, sf).collect()
    assert {r.doc_id for r in five} <= clean and max(sum(1 for r in five if r.doc_id == i) for i in clean) <= 2


def test_registered():
    assert "pipeline" in queries() and "pipeline" not in oracle_sql()
    assert {n for n in queries() if n.startswith("op")} == {
        "op1_template_decontamination", "op2_scaled_sketch", "op3_quality_kernel", "op4_token_counts", "op5_chat_segments",
        "op6_subword_lattice", "op7_language_masks", "op8_near_groups", "op9_suffix_dedup", "op10_source_mix",
        "op11_spelling_variants", "op12_collision_search", "op13_merkle_manifest"}


def test_odd_tables(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "A small text.", None, None, 13), (2, "A small text.", None, None, 13),
            (3, "word " * 30_000, "en", "a", 150_000)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema).selectExpr("*", "1 AS row", "2 AS kept", "3 AS mark", "4 AS hash", "5 AS score", "6 AS component_id")
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
            assert docs.columns == names
            if not data:
                assert docs.count() == 0


def test_planted_passages(spark, sf):
    """Passages of 51 and more words go from all texts that hold them; shorter ones and all else stay."""
    import random

    rng = random.Random(8)
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    word = lambda: "".join(rng.choice("abcdefghéß") for _ in range(rng.randint(2, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    shared = [say(n) for n in (51, 55, 70, 200, 50, 30)]
    kept, rows = {}, []
    for i in range(24):
        # What stands next to a passage differs from text to text.
        front, back = say(60) + f" {chr(65 + i)}", f"{chr(65 + i)} " + say(40) + " \ufffd"
        middle = f"\n{shared[i % 6]}\n"
        rows.append((i, front + middle + back, "en", "a", len(front + middle + back)))
        kept[i] = front + ("" if i % 6 < 4 else middle) + back
    docs = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["suffix_dedup"](spark, docs, sf).collect()}
    assert {i: r.text for i, r in got.items()} == kept
    assert all(r.n_chars == len(r.text) for r in got.values())
