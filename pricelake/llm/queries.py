"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelake.llm import (
    chat, collide, decontam, langid, lattice, manifest, minhash, mixing, quality, sketch, spelling, suffix, tokens)
from pricelake.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_template_decontamination")
def template_decontamination(spark, sf_dir):
    """One row for each document and benchmark item found in it."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = decontam.contaminated(documents(spark, sf_dir).select("doc_id", "text"), items)
    return out.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "covered", F.col("size").alias("n_tokens"),
        "same_slots", (F.col("covered") / F.col("size")).alias("coverage"))


@query("op2_scaled_sketch")
def scaled_sketch(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = sketch.add_sketch(docs, "text", "own")
    pairs = sketch.with_next(docs, "doc_id", {"text": "next_text", "own": "next_own"})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    pairs = sketch.add_sketch(pairs, "edited", "changed")
    return pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketch.as_text(F.col("own")).alias("fingerprint"),
        sketch.as_text(F.col("changed")).alias("edited_fingerprint"),
        sketch.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        sketch.likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        sketch.containment(F.col("own"), F.col("changed")).alias("held_by_edited"))


def fold(folds: int):
    """Remainder of crc32 of the id's decimal text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


@query("op3_quality_kernel")
def quality_kernel(spark, sf_dir):
    docs = materialize(quality.describe(documents(spark, sf_dir).select("doc_id", "text")), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    known = docs.filter(fold(5) != 0).join(labels, "doc_id").withColumn("calibrate", fold(5) == 1)
    out = quality.apply(docs, quality.fit(known))
    return out.select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_token_counts")
def token_counts(spark, sf_dir):
    out = tokens.count_tokens(documents(spark, sf_dir), model_path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM rows),
walked AS (SELECT conv_id, list_reduce(list_prepend('start', list(place || ':' || role ORDER BY place)), lambda state, said:
    CASE WHEN starts_with(state, 'broken') THEN state
         WHEN state = 'start' AND substr(said, strpos(said, ':') + 1) = 'system' THEN 'briefed'
         WHEN state IN ('start', 'briefed', 'answered') AND substr(said, strpos(said, ':') + 1) = 'user' THEN 'asked'
         WHEN state = 'asked' AND substr(said, strpos(said, ':') + 1) = 'assistant' THEN 'answered'
         ELSE 'broken ' || split_part(said, ':', 1) END) AS state FROM placed GROUP BY conv_id),
shown AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + 2 * length(role || text) - length(replace(replace(replace(role || text, '<', ''), '[', ''), '\', '')))
         ::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id)
SELECT shown.*, state = 'answered' AS valid, CASE WHEN starts_with(state, 'broken') THEN substr(state, 8)::BIGINT END AS bad_turn
FROM shown JOIN walked ON shown.conv_id IS NOT DISTINCT FROM walked.conv_id
"""


@query("op5_chat_segments", CHAT_SQL)
def chat_segments(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.format_chats(rows.union(more))
    turns = chat.read_back(F.col("formatted"))
    out = out.withColumns({"turns": turns, "learnt": chat.loss_text(F.col("segments"))})
    newline = F.lit("\n")
    shown = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), "")
    return out.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        "valid", F.col("bad_turn").cast("long").alias("bad_turn"))


@query("op6_subword_lattice")
def subword_lattice(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("learn", fold(7) != 2)
    model, rare = lattice.learn(docs, tokens.read_model(model_path("piece_bpe_32k.model")))
    out = lattice.score(docs, model, rare)
    return out.select(
        "doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op7_language_masks")
def language_masks(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    filters = langid.learn(docs.filter(fold(3) != 1))
    out = langid.predict(docs.select("doc_id", "text"), filters)
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


@query("op8_near_groups")
def near_groups(spark, sf_dir):
    out = minhash.group_near(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query("op9_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    out = suffix.strip_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS z FROM d GROUP BY source),
w AS (SELECT source, z, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
o AS (SELECT *, z * 2.0 AS cap, sum(z) OVER () * 1.5 - coalesce(sum(z * 2.0) OVER (
        ORDER BY z * 2.0 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER (ORDER BY z * 2.0 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ow FROM w),
l AS (SELECT arg_min(rest / ow, cap / w) FILTER (NOT cap * ow <= rest * w) AS level FROM o),
t AS (SELECT source, z, CASE WHEN cap * ow <= rest * w THEN cap ELSE w * level END AS target FROM o, l),
r AS (SELECT d.doc_id, d.size, t.z, t.target, CASE WHEN t.z > 0 THEN t.target / t.z ELSE 0.0 END AS rate,
        ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS coin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z::BIGINT AS source_size, target,
       (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


@query("op10_source_mix", MIX_SQL)
def source_mix(spark, sf_dir):
    out = mixing.repetitions(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").cast("long").alias("source_size"),
        F.col("mix_target").cast("double").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"))


POLY_SQL = """poly AS (SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"""


def crc_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes in DuckDB; the query joins the one row of `poly`."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: {byte})"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), "
            "lambda c, b: xor(c // 256, poly.t[xor(c, b) % 256 + 1])))")


SPELLING_SQL = rf"""
WITH RECURSIVE {POLY_SQL},
t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS c FROM t WHERE length(run) >= 5 GROUP BY 1, 2),
h AS (SELECT run, c, {crc_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM u, poly),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.rest
         UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.rest),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS i, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 2 * v.n THEN b.other END AS form,
        CASE WHEN b.n >= 2 * v.n THEN b.n END AS form_n
      FROM v LEFT JOIN best b ON b.word = v.word AND b.i = 1),
r AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT r.word, f.form, k + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.*, x.root FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM r GROUP BY word) x USING (word)
"""


@query("op11_spelling_variants", SPELLING_SQL)
def spelling_variants(spark, sf_dir):
    out = spelling.group_variants(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("word", "n", "n_near", "form", "form_n", "root")


@query("op12_collision_search")
def collision_search(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return collide.nearest(vectors, F.col("vec_id") % 20 == 0, 20)


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR)) || ':' || ({value})::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE {POLY_SQL},
d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf_sql('n_chars')} AS leaf,
        CASE WHEN {crc_sql('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql('n_chars')} END AS claimed
      FROM documents, poly),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        count(*) OVER (PARTITION BY tree) AS n FROM d),
lev AS (SELECT tree, idx, 0::BIGINT AS k, n, leaf AS h FROM l
        UNION ALL SELECT tree, idx // 2, k + 1, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
        FROM lev WHERE n > 1 GROUP BY tree, idx // 2, k, n),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM lev WHERE n = 1),
top AS (SELECT idx, 0::BIGINT AS k, n, subroot AS h FROM sub
        UNION ALL SELECT idx // 2, k + 1, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
        FROM top WHERE n > 1 GROUP BY idx // 2, k, n),
want AS (SELECT tree, idx, k, xor(idx >> k, 1) AS sib FROM (SELECT tree, idx, n, unnest(range(62)) AS k FROM l) WHERE n > 1::BIGINT << k),
low AS (SELECT w.tree, w.idx, list(CASE WHEN s.h IS NULL THEN '-' WHEN w.sib % 2 = 0 THEN 'l' || s.h ELSE 'r' || s.h END ORDER BY w.k) AS steps
        FROM want w LEFT JOIN lev s ON s.tree = w.tree AND s.k = w.k AND s.idx = w.sib GROUP BY 1, 2),
want2 AS (SELECT idx, k, xor(idx >> k, 1) AS sib FROM (SELECT idx, n, unnest(range(62)) AS k FROM sub) WHERE n > 1::BIGINT << k),
high AS (SELECT w.idx, list(CASE WHEN s.h IS NULL THEN '-' WHEN w.sib % 2 = 0 THEN 'l' || s.h ELSE 'r' || s.h END ORDER BY w.k) AS steps
        FROM want2 w LEFT JOIN top s ON s.k = w.k AND s.idx = w.sib GROUP BY 1),
j AS (SELECT l.*, sub.subroot, (SELECT h FROM top WHERE n = 1) AS root,
        list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
      FROM l JOIN sub USING (tree) LEFT JOIN low ON low.tree = l.tree AND low.idx = l.idx LEFT JOIN high ON high.idx = sub.idx),
f AS (SELECT *, list_reduce(list_prepend(claimed, steps), lambda a, s: sha256(
        CASE s[1] WHEN 'l' THEN substr(s, 2) || a WHEN 'r' THEN a || substr(s, 2) ELSE a END)) AS folded_root FROM j)
SELECT doc_id, leaf, subroot, root, folded_root, folded_root = root AS verified,
       sha256(list_reduce(list_prepend('', list_transform(steps, lambda s: substr(s, 2))), lambda a, s: a || s)) AS proof_sha256
FROM f
"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def merkle_manifest(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = [*fields[:3], F.col("n_chars") + 1, fields[4]]
    leaves = docs.select(
        manifest.tree_key(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("id"),
        manifest.leaf_digest(fields).alias("digest"),
        F.when(fold(7) == 0, manifest.leaf_digest(tampered)).alias("claimed"))
    return manifest.prove_all(leaves).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
        "folded_root", "verified")
