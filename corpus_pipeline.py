"""The corpus pipeline: quality, near-duplicates, contamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each stage's rows to the
shared folder as Parquet and reads them back as the next stage's documents, so a lost executor costs one
stage's tasks at most. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontam, neardup, packing, pii, quality
from skein.llm.common import cut, numbered, table, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts. Each row is judged by its own text; a null text is an empty one."""
    row, score = unused(docs, "_row"), unused(docs, "_score")
    rows = numbered(docs, "quality-rows", row)
    scores = quality.quality_scores(rows, table(spark, sf_dir, "labels"), by=row).select(F.col("id").alias(row), F.col("score").alias(score))
    return rows.join(scores.filter(F.col(score) >= 0.3).select(row), row, "left_semi").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near-duplicates; texts without words are no group.

    Rows are told apart by numbers of this stage, so rows without a doc_id, or of one doc_id, are kept or
    go by their texts. A row without a doc_id stands for a group only if no other can.
    """
    row = unused(docs, "_row")
    rows = numbered(docs, "near-rows", row)
    groups = neardup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("component_id").alias("group"))
    ids = rows.select(row, F.col("doc_id").alias("id")).join(groups, row)
    kept = ids.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(row).alias("row"))).alias("first")).select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate; each row by its own text."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced in their texts; null texts stay null, whatever the doc_id."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a document without a doc_id has pieces without one, a null text its end token alone."""
    pieces = packing.pack(docs)
    return packing.digest(pieces)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained models and connected components: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
