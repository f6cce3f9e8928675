"""The keep-first stream against the batch rule, for several orders of arrival and over a restart."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.session import shared_dir
from postmill.streaming import streams

SCHEMA = "id string, note string, scan_pos long"


def rows_of(n=120):
    r = random.Random(6)
    return [(r.choice(["a", "b", "c", "d", "", None, f"k{i % 9}"]), f"n{i}", i) for i in range(n)]


def fed(spark, parts, restart_after=None):
    path, out, state = (shared_dir(spark, n) for n in ("in", "out", "state"))
    for number, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        if restart_after is None or number in restart_after or number == len(parts) - 1:
            stream = streams.file_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
            streams.stream_keep_first(stream, "id", out, state).awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize(("order", "restart_after"), [((2, 1, 0), ()), ((0, 1, 2), (0,)), ((1, 2, 0), (0, 1))])
def test_folded_changes_equal_the_batch(spark, order, restart_after):
    rows = rows_of()
    random.Random(len(order)).shuffle(rows)
    rows.sort(key=lambda r: r[2] // 40)
    parts = [[r for r in rows if r[2] // 40 == k] for k in order]
    changes = fed(spark, parts, restart_after)
    assert sorted(((r.id or "", r.note, r.scan_pos) for r in streams.first_rows(changes).collect())) == plain(rows)
    balance = changes.groupBy("_key").agg(F.sum("change").alias("n"))
    assert {r.n for r in balance.collect()} == {1}


def plain(rows):
    least = {}
    for i, note, pos in rows:
        key = i or f"row:{pos}"
        if key not in least or pos < least[key][2]:
            least[key] = (i or "", note, pos)
    return sorted(least.values())


def test_copies_within_and_over_batches(spark):
    parts = [[("x", "late", 9), ("x", "later", 10)], [("x", "middle", 5), ("y", "only", 3)], [("x", "last", 7)], [("x", "first", 1), ("x", "same", 1)]]
    changes = fed(spark, parts)
    got = sorted((r.change, r.scan_pos) for r in changes.where("id = 'x' OR change < 0").collect())
    assert got == [(-1, 5), (-1, 9), (1, 1), (1, 5), (1, 9)]
    assert streams.first_rows(changes).count() == 2
