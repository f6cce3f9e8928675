"""Frequency dictionaries: parse, validate, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import strip

CHECKED_LINES = 1000  # fixed value: lines looked at by the validation
MAX_BAD_SHARE = 0.1   # fixed value: invalid lines per valid line


def _fields(lines: DataFrame) -> DataFrame:
    text = strip(F.col("line"))
    words = F.split(text, r"(?U)\s+")
    pair = F.size(words) == 2
    return lines.withColumns({
        "_skip": (text == "") | F.startswith(text, F.lit("#")),
        "word": F.when(pair, words[0]),
        "freq": F.when(pair, F.regexp_replace(F.get(words, F.lit(1)), r"(?<=\d)_(?=\d)", "").try_cast("bigint")),
    })


def parse_lines(lines: DataFrame) -> DataFrame:
    """``word freq`` rows of a frame with a ``line`` column; other columns stay."""
    parsed = _fields(lines).where(~F.col("_skip") & F.col("freq").isNotNull())
    return parsed.drop("_skip", "line")


def validate(lines: DataFrame, checked: int = CHECKED_LINES) -> DataFrame:
    """Per file: valid and invalid counts among its first lines, and a verdict.

    ``lines`` has ``source``, ``line_no`` and ``line``. Only the first lines of a file are ranked,
    and each task keeps no more of them than are checked.
    """
    head = lines.withColumn("_rank", F.row_number().over(Window.partitionBy("source").orderBy("line_no")))
    head = _fields(head.where(F.col("_rank") <= checked)).where(~F.col("_skip"))
    good = F.col("freq").isNotNull() & (F.col("freq") >= 0)
    counted = head.groupBy("source").agg(
        F.count_if(good).alias("valid"), F.count_if(~good).alias("invalid"))
    all_files = lines.groupBy("source").agg(F.count(F.lit(1)).alias("lines"))
    v, i = F.coalesce("valid", F.lit(0)), F.coalesce("invalid", F.lit(0))
    # fixed values: the messages
    verdict = (F.when(v == 0, "No valid word-frequency pairs found")
               .when(i > v * MAX_BAD_SHARE, F.concat(
                   F.lit("Too many invalid lines: "), i.cast("string"), F.lit("/"), (v + i).cast("string")))
               .otherwise(""))
    return all_files.join(counted, "source", "left").select(
        "source", v.alias("valid"), i.alias("invalid"), (verdict == "").alias("is_valid"), verdict.alias("message"))


def merge(lines: DataFrame) -> DataFrame:
    """Words of all valid files with their highest frequency."""
    ok = validate(lines).where("is_valid").select("source")
    parsed = parse_lines(lines).join(ok, "source", "left_semi")
    return parsed.groupBy("word").agg(F.greatest(F.max("freq"), F.lit(0)).alias("freq"))


def by_frequency(dictionary: DataFrame) -> DataFrame:
    return dictionary.orderBy(F.desc("freq"), "word")


def from_texts(texts: DataFrame, column: str = "text") -> DataFrame:
    """A dictionary counted from a corpus: lower-cased runs of letters."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
