"""Readers. Schemas are explicit, and rows that cannot be parsed are marked, not lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.operators.messages import drop_unparsed
from postmill.schema import ATTACHMENTS, FOLDERS, MESSAGES

CORRUPT = "_corrupt_record"


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", keep_unparsed: bool = False) -> DataFrame:
    """Message rows from parquet, ORC or JSON lines, subfolders included."""
    if fmt != "json":
        return spark.read.format(fmt).schema(MESSAGES).option("recursiveFileLookup", "true").load(path)
    schema = T.StructType(MESSAGES.fields + [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
          .option("recursiveFileLookup", "true").json(path))
    if keep_unparsed:
        return df
    # The reader refuses plans that use the marker and no field; a length is never negative.
    return drop_unparsed(df.withColumn(CORRUPT, F.coalesce(CORRUPT, F.when(F.length("folder_path") < 0, ""))))


def parse_messages(lines: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """JSON text column to message columns; ``_corrupt_record`` holds lines that are no JSON object."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.select(F.from_json(column, full, options).alias("m")).select("m.*")


def read_attachments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(ATTACHMENTS).load(path)


def read_attachment_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Stored files as rows: path, size, content. Content is read only if it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return files.load(path).select("path", F.col("length").alias("size"), "modificationTime", "content")


def read_folders(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(FOLDERS).load(path)


def read_dictionary_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of dictionary files with their place: ``source``, ``line_no`` (ascending in a file), ``line``.

    A row's id grows along its split, and the split's start grows along the file, so the pair
    orders lines as they stand even where a large file is split.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("source"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("line_no"),
        F.col("value").alias("line"))
    return lines


def union_mailboxes(*frames: DataFrame) -> DataFrame:
    """Several mailboxes or chunks of one, by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
