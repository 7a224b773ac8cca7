"""From raw documents to token ids: the training-data pipeline.

Each stage takes what the one before it kept. ``run`` writes a stage's result to
the shared folder and reads it again for the next, so a lost executor costs no
more than the stage at work.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movelens.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_ranker
from movelens.sources.staging import stage


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; the labels' held-out fold is not learned from."""
    held_out = quality_ranker.in_fold(F.col("doc_id"), 5, 0)
    scored = quality_ranker.scored(docs, "doc_id", "text", _table(spark, sf_dir, "labels"), "quality", ~held_out)
    return scored.filter(F.col("score") >= quality_ranker.CUT).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; ``n_chars`` follows the text."""
    out = line_dedup.without_repeated_lines(docs, "doc_id", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    return jaccard_join.keep_first_of_groups(docs, "doc_id", "text", size=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontaminate.decontaminate(docs, "doc_id", "text", _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids; the text is what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.with_tokens(docs, "text", path, "token_ids", back="text")
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("tokens", tokens),
]

# The classifier, the edit join and the encoder have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
