"""The corpus pipeline: stages that each read what the one before wrote.

Quality rules, near duplicates, benchmark decontamination, redaction of personal data, SentencePiece ids.  All but the last
return the columns of ``documents``; the last returns ``doc_id``, the piece ids and the proof of the round trip.

All stages run in the same executors, whose memory grows from one to the next: tasks work on little text at a time.  A
stage's table may be written after its function has ended, so a stage leaves small batches set; ``run`` sets them back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from signalframe.llm import decontaminate, neardup, pieces, pii, quality
from signalframe.llm.kernels import Scratch, read, set_small_batches, small_batches

DECONTAMINATED = 1 << 19  # bytes of text that a task works on at once
ENCODED = 1 << 17


def _in_small_batches(stage: Callable) -> Callable:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        set_small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_quality(docs)


@_in_small_batches
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.keep_first(docs, percent=80)


@_in_small_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"), most=DECONTAMINATED)


@_in_small_batches
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


@_in_small_batches
def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become piece ids."""
    return pieces.round_trip(docs, pieces.Pieces.load(), ENCODED)


STAGES = [
    ("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("sentencepiece", sentencepiece_stage),
]

ORACLE_SQL = None  # perplexity and Viterbi are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES:
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
