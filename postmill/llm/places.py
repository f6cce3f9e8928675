"""Places of rows in a global order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.shipping import ship
from postmill.session import written


def _run_starts(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; the first place included."""
    if len(column) < 2:
        return np.arange(len(column))
    change = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.nonzero(change)[0] + 1])


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place (from 0) within ``group`` in ``order``, and ``n``, the rows of the group.

    ``group`` is a string column without nulls. Ranges of (group, order) are sorted side by side; each counts its own
    rows of each group, and the counts of ranges are summed on the small table of ranges. Equal rows get
    different places, and a salt lets a row that is repeated very often fill several ranges.
    """
    ship(rows.sparkSession)
    columns = rows.columns
    fields = rows.schema.simpleString()[len("struct<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(group)
            starts = _run_starts(names)
            sizes = np.diff(np.append(starts, batch.num_rows))
            within = np.arange(batch.num_rows, dtype=np.int64) - np.repeat(starts, sizes)
            if names[0].as_py() == last:
                within[:sizes[0]] += seen
            last, seen = names[-1].as_py(), int(within[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, columns), pa.array(within), pa.array(np.full(batch.num_rows, part, np.int32))],
                [*columns, "_within", "_part"])

    keys = [group, *order, "_salt"]
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    counted = written(ranged.drop("_salt").mapInArrow(run, ",".join([fields, "_within:bigint", "_part:int"])), "ranges")
    sizes = counted.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
    whole, earlier = Window.partitionBy(group), Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(group, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
                          F.sum("_rows").over(whole).alias("n"))
    return counted.join(before, [group, "_part"]).select(
        *columns, (F.col("_within") + F.col("_before")).alias("idx"), "n")
