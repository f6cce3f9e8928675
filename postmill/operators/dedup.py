"""Keep-first duplicate removal."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.identity import dedup_key


def record_key() -> Column:
    """Email_ID, else Message_ID, else subject|sender|time; '' if all are empty."""
    return dedup_key(*[F.col(c) for c in (
        "Email_ID", "Message_ID", "Subject", "Sender_Email", "From", "Date_Received", "Date_Sent")])


def keep_first(df: DataFrame, key: Column, order: Sequence[str] = ("scan_pos",)) -> DataFrame:
    """The first row of each key in ``order``; rows with a null or empty key all stay.

    ``order`` must tell any two rows of a key apart. Only the key and the order columns are
    aggregated (with map-side combine, so a hot key shrinks to one row per task before the
    shuffle), and only keys seen twice are kept for the join. While those fit the session's
    broadcast bound the wide rows are never moved; beyond it the runtime falls back to a
    sort-merge join and splits hot keys.
    """
    keyed = df.withColumn("_key", F.coalesce(key, F.lit("")))
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    counted = keyed.groupBy("_key").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_copies"))
    # One condition over key and count, so the key is not computed a second time below the aggregate.
    repeated = counted.where(F.when(F.col("_key") == "", 0).otherwise(F.col("_copies")) > 1).drop("_copies")
    # Rows without a key match nothing; each gets a value of its own so they do not meet in one task.
    own = F.concat(F.lit("\0"), place.cast("string"))
    spread = keyed.withColumn("_key", F.when(F.col("_key") == "", own).otherwise(F.col("_key")))
    kept = spread.join(repeated, "_key", "left").where(F.col("_first").isNull() | (F.col("_first") == place))
    return kept.drop("_key", "_first")


def dedup_stats(df: DataFrame, key: Column) -> DataFrame:
    """total, unique and duplicate rows; each row without a key is its own."""
    per_key = df.select(F.coalesce(key, F.lit("")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    unique = F.sum(F.when(F.col("k") == "", F.col("n")).otherwise(1))
    out = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(unique, F.lit(0)).alias("unique"))
    return out.withColumn("duplicates", F.col("total") - F.col("unique"))


def once_per_text(df: DataFrame, column: str, work: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """Run ``work`` once per distinct text and give every row its result.

    ``work`` takes a frame with ``column`` and returns it with ``out`` added. Rows are matched by a
    256-bit digest, so long texts are not join keys; copies are combined before the shuffle.
    """
    keyed = df.withColumn("_digest", F.sha2(F.coalesce(F.col(column), F.lit("")), 256))
    texts = keyed.groupBy("_digest").agg(F.any_value(column).alias(column))
    done = work(texts).select("_digest", out)
    return keyed.join(done, "_digest", "left").drop("_digest")
