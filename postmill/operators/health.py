"""Mailbox health from a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.index import side_by_side

SAMPLE_LIMIT = 200  # fixed value: messages looked at


def health_score(corrupted: Column, sampled: Column) -> Column:
    ratio = F.greatest(F.lit(0.0), 1.0 - corrupted / F.greatest(F.lit(1), sampled))
    return F.when(sampled <= 0, F.lit(100.0)).otherwise(F.bround(ratio * 100.0, 1))


def mailbox_health(messages: DataFrame, bad: Column, counts: DataFrame, size: DataFrame,
                   sample_limit: int = SAMPLE_LIMIT) -> DataFrame:
    """One row: totals, and the share of unreadable messages among the first ``sample_limit``.

    The sample is the operator's meaning; it is taken in scan order, so Spark keeps that many rows
    per task and merges them. ``bad`` also holds for the messages of a folder that cannot be read.
    ``counts`` has total_count per folder, ``size`` one row with ``bytes``.
    """
    sample = (messages.select("scan_pos", bad.alias("bad")).orderBy("scan_pos").limit(sample_limit)
              .agg(F.count_if("bad").alias("corrupted_samples"), F.count(F.lit(1)).alias("sampled")))
    tree = counts.agg(
        F.coalesce(F.sum("total_count"), F.lit(0)).alias("total_emails"),
        F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("folder_count"))
    return side_by_side(tree, sample, size.select("bytes")).select(
        "total_emails", "folder_count", "corrupted_samples", "sampled",
        F.round(F.coalesce("bytes", F.lit(0)) / 1048576.0, 2).alias("estimated_size_mb"),
        health_score(F.col("corrupted_samples"), F.col("sampled")).alias("health_score"))
