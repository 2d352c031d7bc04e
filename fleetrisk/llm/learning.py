"""Which labelled rows a classifier learns from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """doc_id, label of at most `rows` labelled documents outside the held-out fold, always the same ones: those whose ids have the least hashes.

    Rows without id or label are left out; of conflicting labels of an id the larger counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(remainder(F.col("doc_id"), folds) != held_out)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return known.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(rows)


def learned_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, label, text of the chosen rows (a bounded number, so that they may be broadcast). A null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
