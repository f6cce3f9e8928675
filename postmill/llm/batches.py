"""Arrow batches cut into pieces of bounded text size, and the narrow frames the operators start from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.shipping import ship

# Bytes of text that a task holds as Python objects at a time; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, whatever else the frame holds; the executors get the library."""
    ship(docs.sparkSession)
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the key as text leaves 2 after division by 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def one_row_each(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): of the rows with equal keys the text of the least hash, so that a repeated id is one row."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def rowwise(docs: DataFrame, run) -> DataFrame:
    """mapInArrow with the columns of ``docs`` as they are."""
    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
