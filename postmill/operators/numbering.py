"""Exact positions inside a group without putting a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rows_before(counts: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """Rows that lie before each block; ``counts`` has one row per keys + levels, with ``_n``."""
    outer, finest = keys + levels[:-1], levels[-1]
    earlier = Window.partitionBy(*outer) if outer else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy(finest).rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if len(levels) == 1:
        return within.select(*keys, *levels, "_before")
    coarse = _rows_before(counts.groupBy(*outer).agg(F.sum("_n").alias("_n")), keys, levels[:-1])
    coarse = coarse.withColumnRenamed("_before", "_coarse")
    return within.join(coarse, outer).select(
        *keys, *levels, (F.col("_before") + F.col("_coarse")).alias("_before"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], blocks: Sequence[Column],
             name: str, first: int = 0) -> DataFrame:
    """Add ``name``: the row's position among the rows with equal ``keys`` in ``order``.

    ``blocks`` are expressions that never decrease along ``order`` and cut a group into pieces,
    coarse to fine. Rows are sorted per piece, so one group with a third of all rows is spread
    over many tasks; the lengths of the pieces are summed on the small table of pieces. The key
    columns and blocks must not be null.
    """
    keys = list(keys)
    levels = [f"_block{i}" for i in range(len(blocks))]
    cut = df.withColumns(dict(zip(levels, blocks, strict=True)))
    counts = cut.groupBy(*keys, *levels).agg(F.count(F.lit(1)).alias("_n"))
    before = _rows_before(counts, keys, levels)
    local = Window.partitionBy(*keys, *levels).orderBy(*order)
    ranked = cut.withColumn("_local", F.row_number().over(local))
    return (ranked.join(before, keys + levels)
            .withColumn(name, F.col("_local") + F.col("_before") + F.lit(first - 1))
            .drop("_local", "_before", *levels))
