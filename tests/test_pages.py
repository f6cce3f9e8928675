"""Folder pages by a directory against counting the whole folder."""

import random

import pytest
from test_search import scanned

from postmill.operators import messages, pages

SCHEMA = "folder_path string, pos long, subject string, parsed boolean, _other int"


def stored(spark, rows, block):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return df, pages.build(df, block_rows=block)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_pages_equal_the_counting_form(spark, block):
    r = random.Random(block)
    rows = [(r.choice(["/Root/A", "/Root/B", "/Root/A", "/Root"]), i * 3, f"s{i}", r.random() < 0.6, i) for i in range(400)]
    df, found = stored(spark, rows, block)
    for folder, start, limit in [("/Root/A", 0, 10), ("/Root/A", 63, 64), ("/Root/B", 5, 1), ("/Root", 90, 100), ("/Root/A", 500, 5), ("/Root/None", 0, 5), ("/Root/B", 0, 0),
                                 ("/Root/A", -3, 4)]:
        want = [tuple(x) for x in messages.folder_page(df, folder, start, limit).collect()]
        got = pages.page(spark, found, folder, start, limit)
        assert [tuple(x) for x in got.collect()] == want
        assert got.columns == [*df.columns, "message_index"]


def test_a_late_page_of_a_hot_folder_reads_two_blocks(spark):
    rows = [("/Root/Hot", i, "x" * 20, i % 3 > 0, 0) for i in range(60_000)] + [("/Root/Cold", i, "y", True, 0) for i in range(300)]
    df, found = stored(spark, rows, 500)
    for start in (0, 30_250, 59_990):
        page = pages.page(spark, found, "/Root/Hot", start, 100)
        assert scanned(page) <= 2 * 500
    assert [x.message_index for x in pages.page(spark, found, "/Root/Hot", 30_250, 3).collect()] == [30250, 30251, 30253]


def test_unreadable_blocks_and_no_messages(spark):
    rows = [("/Root/A", i, "x", i >= 95, 0) for i in range(100)]
    df, found = stored(spark, rows, 10)
    assert [x.message_index for x in pages.page(spark, found, "/Root/A", 3, 2).collect()] == [95, 96]
    assert pages.page(spark, pages.build(df.limit(0)), "/Root/A").collect() == []
    with pytest.raises(ValueError, match="absolute"):
        pages.page(spark, found, "Root")
