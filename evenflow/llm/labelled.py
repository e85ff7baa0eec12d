"""Bounded samples of labelled rows, for models that are fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenflow.llm.text_stats import FEATURES, ratios, with_statistics

MAX_TRAIN = 20_000


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether the row belongs to the held-out part: crc32 of the id as text; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN,
) -> tuple[np.ndarray, np.ndarray]:
    """Features (in the order of ``FEATURES``) and 0/1 labels of at most ``max_rows`` labelled documents.

    Those with the smallest id hashes are taken, so the sample is the same for every partitioning; ``max_rows`` bounds
    what is broadcast and what the driver holds. Null ids and labels are left out; of several labels of one id the
    largest counts; a repeated id counts once, with its smallest text.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(
        F.max(label).cast("int").alias("__label"))
    there = marks.join(docs.select(F.col("doc_id").alias("__id")).distinct(), "__id", "left_semi")
    few = there.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(few), "__id").groupBy("__id", "__label").agg(
        F.min("text").alias("text"))
    rows = with_statistics(texts).select("__id", "__label", *(c.alias(n) for n, c in ratios().items())).orderBy("__id").collect()
    data = np.array([[float(r["__label"]), *(float(r[n]) for n in FEATURES)] for r in rows], dtype=np.float64)
    data = data.reshape(len(rows), len(FEATURES) + 1)
    return data[:, 1:], (data[:, 0] > 0).astype(np.float64)
