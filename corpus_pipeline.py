"""From raw documents to a training mix, in stages that are written and read again.

Every stage takes the documents that the one before it kept and returns the columns of
documents; the last may repeat documents. Rows are kept with all their columns; extra
columns bear other names inside a stage, so that they cannot clash with those of its operator.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricelake import scratch_path
from pricelake.llm import decontam, langid, minhash, mixing, suffix


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(stage):
    """The stage with extra columns renamed on the way in and named as before on the way out."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in DOCUMENT else f"extra_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return run_stage


def columns_of(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


@shielded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go; a missing language is filled in."""
    known = langid.predict(docs, langid.learn(docs)).filter(F.col("lang_pred") != langid.UND)
    return columns_of(known.withColumn("lang", F.coalesce("lang", "lang_pred")), docs)


@shielded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    return columns_of(minhash.group_near(docs).filter("kept"), docs)


# A passage of more than 50 words that occurs elsewhere goes, as does a repeat of 400 bytes, whatever
# its words. Repeats are searched from 150 bytes on: 51 words of less than three letters at a mean
# are the only passages that can be shorter.
PASSAGE_WORDS = 50
PASSAGE_BYTES = 400
WINDOW_BYTES = 150
ANCHOR_BYTES = 50


def too_short(run: Column, size: Column) -> Column:
    words = F.regexp_count(F.make_valid_utf8(run.cast("string")), F.lit(r"[^\x20\x09-\x0D]+"))
    return (words <= PASSAGE_WORDS) & (size < PASSAGE_BYTES)


@shielded
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere are cut out of the texts; a character cut in two goes as well."""
    cut = suffix.strip_repeats(docs, WINDOW_BYTES, gram=ANCHOR_BYTES, whole_characters=True, keep=too_short)
    rest = F.col("kept").cast("string")
    cut = cut.withColumn("text", F.when(F.col("n_removed") > 0, rest).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(
            F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return columns_of(cut, docs)


@shielded
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@shielded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that the sources approach their target weights."""
    return mixing.emit(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

# Classifiers, similarity joins and byte-level repeats have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
