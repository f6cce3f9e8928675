"""Folder pages from a clustered copy of the messages and a directory of its blocks.

Messages are stored by folder and position, with their position and the number of readable messages before them, and cut
into blocks by position. The directory has a row per block. A page looks up its first block there and reads the rows of the
blocks that it needs, however long the folder is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.operators.messages import with_message_index
from postmill.session import shared_dir

# Messages of a block, which is a row group of the files.
BLOCK_ROWS = 4096
_OWN = ["message_index", "_block", "_before"]


@dataclass(frozen=True)
class Pages:
    """Folders of the clustered messages and of the directory, and the messages' columns."""

    root: str
    block_rows: int

    def messages(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/messages")

    def directory(self, spark: SparkSession) -> DataFrame:
        """(folder_path, _block, first, readable, before): of each block its first position, its readable messages and
        those of the folder before it."""
        return spark.read.parquet(f"{self.root}/directory")


def build(df: DataFrame, root: str | None = None, block_rows: int = BLOCK_ROWS) -> Pages:
    """Writes the messages (folder_path, pos and more; ``parsed`` false where unreadable) and their directory.

    Positions are counted on narrow rows and joined to the messages, which are sorted in ranges of (folder, position): a
    folder with a third of all messages fills many files.
    """
    pages = Pages(root or shared_dir(df.sparkSession, "pages"), block_rows)
    parsed = F.coalesce("parsed", F.lit(True)) if "parsed" in df.columns else F.lit(True)
    narrow = with_message_index(df.select("folder_path", "pos", parsed.alias("_ok"))).withColumn(
        "_block", F.floor(F.col("message_index") / block_rows))
    # Readable ones are counted within blocks, and blocks of a folder, of which there are few, one after another.
    within = Window.partitionBy("folder_path", "_block").orderBy("message_index").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("folder_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ones = F.col("_ok").cast("long")
    blocks = narrow.groupBy("folder_path", "_block").agg(F.min("message_index").alias("first"), F.sum(ones).alias("readable"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("readable").over(earlier), F.lit(0)))
    order = ["folder_path", "_block"]
    blocks.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{pages.root}/directory")
    placed = narrow.withColumn("_within", F.coalesce(F.sum(ones).over(within), F.lit(0))) \
        .join(pages.directory(df.sparkSession).select(*order, "before"), order) \
        .select("folder_path", "pos", "message_index", "_block", (F.col("before") + F.col("_within")).alias("_before"))
    rows = df.join(placed, ["folder_path", "pos"]).select(*[df[c] for c in df.columns], *_OWN)
    order = ["folder_path", "message_index"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write \
        .option("parquet.block.row.count.limit", block_rows).parquet(f"{pages.root}/messages")
    return pages


def page(spark: SparkSession, pages: Pages, folder: str, start: int = 0, limit: int = 100) -> DataFrame:
    """Messages of one folder from position ``start``, at most ``limit``, with ``message_index``.

    Unreadable messages hold a position but do not count towards the page. A folder that is not there has no messages.
    """
    if not folder.startswith("/") or not folder.strip("/"):
        raise ValueError("folder must be an absolute path such as /Root/Inbox")
    rows, start = pages.messages(spark), max(start, 0)
    shown = rows.drop("_block", "_before")
    if limit <= 0:
        return shown.limit(0)
    here = F.col("folder_path") == folder
    low = start // pages.block_rows
    directory = pages.directory(spark).where(here)
    known = directory.where(F.col("_block") == low).first()
    if known is None:
        return shown.limit(0)
    # The block holds ``start``; no more than its positions before ``start`` are readable ones that the page leaves out.
    enough = known["before"] + min(start - known["first"], known["readable"]) + limit
    last = directory.where((F.col("_block") >= low) & (F.col("before") < enough)).agg(F.max("_block")).first()[0]
    wanted = rows.where(here & F.col("_block").between(low, last) & (F.col("message_index") >= start))
    if "parsed" in rows.columns:
        wanted = wanted.where(F.coalesce("parsed", F.lit(True)))
    return wanted.drop("_block", "_before").orderBy("message_index").limit(limit)
